"""Readers, stores, streams, pixels."""

from __future__ import annotations

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptrace.functions import image
from cliptrace.functions.bits import hamming, js_round, pack_text
from cliptrace.functions.text import _verdict
from cliptrace.sources import fingerprints as fp
from cliptrace.streaming import ingest as si


def frame(i, seed=0):
    rng = np.random.default_rng(seed * 1000 + i)
    bits = lambda n: "".join(map(str, rng.integers(0, 2, n)))
    v = {"hash": bits(256), "dhash": bits(480), "phash": bits(64)}
    return {"frameIndex": i, "timestamp": (i - 1) / 25, "variants": {"zoom": v, "full": v}, "signature": {"colorGrid": [1.0] * 48, "skinScoreGrid": [0.0] * 16, "detailGrid": [2.0] * 16}}


def test_ndjson_and_json_array_agree(spark, tmp_path):
    frames = [frame(i) for i in range(1, 6)]
    (tmp_path / "v1_fingerprints.ndjson").write_text("\n".join([*map(json.dumps, frames), '{"frameIndex": 6, "timest']))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "v1.json").write_text(json.dumps(frames))
    one = fp.pack(fp.read_ndjson(spark, str(tmp_path / "v1_fingerprints.ndjson"))).orderBy("si").collect()
    two = fp.pack(fp.read_json_array(spark, str(tmp_path / "a"))).orderBy("si").collect()
    assert one == two and len(one) == 5
    assert [v["name"] for v in one[0]["variants"]] == ["full", "zoom"] and len(one[0]["variants"][0]["d"]) == 15 and one[0]["variants"][0]["fa"] is None
    assert one[0]["si"] == 0 and one[0]["ts"] == 0.0 and one[0]["video_id"] == "v1"


def test_pack_text(spark):
    a, b = "01" * 16 + "1" * 8, "01" * 16 + "0" * 8
    r = spark.createDataFrame([(a, b, "")], "a string, b string, e string").select(pack_text(F.col("a")).alias("x"), hamming(pack_text(F.col("a")), pack_text(F.col("b"))).alias("h"), pack_text(F.col("e")).alias("e"), js_round(F.lit(-2.5)).alias("r")).first()
    assert r["x"] == [0xAAAAAAAA, 0xFF] and r["h"] == 8 and r["e"] == [] and r["r"] == -2


def test_store_range_reaches_the_scan(spark, tmp_path):
    df = spark.range(100).select(F.lit("v").alias("video_id"), F.col("id").alias("si"), (F.col("id") / 25).alias("ts"))
    fp.write_store(df, str(tmp_path / "s"))
    got = fp.read_store(spark, str(tmp_path / "s"), "v", 10, 19)
    assert got.count() == 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(si), GreaterThanOrEqual(si,10), LessThanOrEqual(si,19)]" in plan and "PartitionFilters: [isnotnull(video_id" in plan
    assert fp.resume_after(df, got).count() == 90 and fp.between(df, 0.4, 0.8).count() == 11


def test_results_and_history(spark, tmp_path):
    seg = {"shortStart": 0.0, "shortEnd": 1.0, "movieStart": 5.0, "movieEnd": 6.0, "confidence": 90.0, "frameCount": 25, "isApproximate": False, "gapCount": 0, "speedRatio": 1.0, "matchSequence": []}
    (tmp_path / "m1_matchresult.json").write_text(json.dumps({"segments": [seg, seg], "unmatchedRanges": [], "movieFrames": 9, "shortFrames": 3}))
    (tmp_path / "m1_candidates_0.json").write_text(json.dumps({"segmentIndex": 0, "candidates": [{"segment": seg, "checked": True, "verdict": "accepted", "confidencePct": 90}]}))
    (tmp_path / "m1_matchmeta.json").write_text(json.dumps({"status": "processing", "startedAt": 1700000000000}))
    assert fp.read_results(spark, str(tmp_path / "m1_matchresult.json")).count() == 2
    c = fp.read_candidates(spark, str(tmp_path / "m1_candidates_0.json")).first()
    assert c["match_id"] == "m1" and c["verdict"] == "accepted" and c["segment"]["movieStart"] == 5.0
    assert fp.read_meta(spark, str(tmp_path / "m1_matchmeta.json")).first()["job_id"] == "m1"
    h = fp.history(spark, str(tmp_path)).collect()
    assert [(r["job_id"], r["files"]) for r in h] == [("m1", 3)]
    # Written again, the sets read the same.
    fp.write_candidates(fp.read_candidates(spark, str(tmp_path / "m1_candidates_0.json")), str(tmp_path / "again"))
    one = spark.read.schema(fp.CANDIDATES_JSON).json(str(tmp_path / "again")).first()
    assert len(one["candidates"]) == 1 and one["candidates"][0]["segment"]["movieStart"] == 5.0 and one["candidates"][0]["verdict"] == "accepted"


def test_history_after_a_restart(spark, tmp_path):
    def put(name, data=None):
        (tmp_path / name).write_text(json.dumps(data) if data is not None else "x")

    for job, said, parts in [
        ("done", "completed", ["result"]), ("stopped", "stopped", ["result"]), ("failed", "failed", []), ("broke", "processing", ["result", "checkpoint"]),
        ("lost", "completed", []), ("plain", None, ["result"]),
    ]:
        if said:
            put(f"{job}_meta.json", {"status": said, "originalName": job, "fileSize": 5})
        for p in parts:
            put(f"{job}_{p}.json")
    put("m1_matchmeta.json", {"status": "processing"})
    put("m2_matchmeta.json", {"status": "completed"})
    put("m3_matchmeta.json", {"status": "completed"})
    put("m3_matchresult.json", {})
    got = {r["job_id"]: (r["kind"], r["state"], r["error"]) for r in fp.history(spark, str(tmp_path)).collect()}
    assert got == {
        "done": ("video", "completed", None), "stopped": ("video", "stopped", None), "failed": ("video", "failed", None), "broke": ("video", "failed", None),
        "lost": ("video", "failed", None), "plain": ("video", "completed", None), "m1": ("match", "failed", "Interrupted by server restart"),
        "m2": ("match", "failed", "Result file missing"), "m3": ("match", "completed", None),
    }


def test_frames_written_as_lines_read_the_same(spark, tmp_path):
    (tmp_path / "v_fingerprints.ndjson").write_text("\n".join(json.dumps(frame(i)) for i in range(1, 8)) + "\n" + '{"frameIndex"')
    packed = fp.pack(fp.read_ndjson(spark, str(tmp_path / "v_fingerprints.ndjson")))
    fp.write_ndjson(packed, str(tmp_path / "out"))
    raw = spark.read.schema(fp.FRAME_JSON + ", video_id STRING").json(str(tmp_path / "out"))
    assert fp.pack(raw).orderBy("si").collect() == packed.orderBy("si").collect()
    assert [r["lines"] for r in fp.complete_lines(spark, str(tmp_path / "v_fingerprints.ndjson")).collect()] == [7]


def test_complete_lines_of_odd_files(spark, tmp_path):
    for name, data in {"a": b"", "b": b"no end", "c": b"\n", "d": b"x\r\n\n\xff\xfe\n", "e": b"1\n" * 50_000 + b"2"}.items():
        (tmp_path / f"{name}.ndjson").write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1][0]: r["lines"] for r in fp.complete_lines(spark, str(tmp_path)).collect()}
    assert got == {"b": 0, "c": 1, "d": 3, "e": 50_000}


def test_a_long_video_has_several_files_in_order(spark, tmp_path):
    df = spark.range(5_000).select(F.when(F.col("id") < 4_900, "long").otherwise("short").alias("video_id"), F.col("id").alias("si"), (F.col("id") / 25).alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fp.write_store(df, str(tmp_path / "s"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted((tmp_path / "s" / "video_id=long").glob("*.parquet"))
    read = [[r["si"] for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(files) > 2 and [x for part in read for x in part] == list(range(4_900))


def test_meta_round_trip(spark, tmp_path):
    (tmp_path / "j_meta.json").write_text(json.dumps({"status": "completed", "startedAt": 1700000000123}))
    meta = fp.read_meta(spark, str(tmp_path / "j_meta.json"))
    fp.write_meta(meta, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select("startedAt", "status", "job_id").first() == (1700000000123, "completed", "j")


def test_stream_ingest_resumes_without_duplicates(spark, tmp_path):
    src, store, check, bad = (str(tmp_path / n) for n in ("in", "store", "check", "bad"))
    (tmp_path / "in").mkdir()
    lines = [json.dumps(frame(i)) for i in range(1, 11)]
    (tmp_path / "in" / "v_fingerprints.ndjson").write_text("\n".join(lines[:6]))
    si.ingest(spark, src, store, check, bad)
    assert spark.read.parquet(store).count() == 6
    time.sleep(1.1)
    (tmp_path / "in" / "v.ndjson").write_text("\n".join([*lines[4:], json.dumps({"timestamp": 1.0})]))  # overlaps what is stored
    si.ingest(spark, src, store, check, bad)
    got = spark.read.parquet(store)
    assert got.count() == 10 and got.select("si").distinct().count() == 10
    si.ingest(spark, src, store, check, bad)
    assert spark.read.parquet(store).count() == 10


def test_names_that_look_like_numbers_stay_apart(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "s")
    src.mkdir()
    (src / "7_fingerprints.ndjson").write_text("\n".join(json.dumps(frame(i, 1)) for i in range(1, 4)))
    si.ingest(spark, str(src), store, str(tmp_path / "c"))
    (src / "007_fingerprints.ndjson").write_text("\n".join(json.dumps(frame(i, 2)) for i in range(1, 6)))
    si.ingest(spark, str(src), store, str(tmp_path / "c"))
    got = fp.read_store(spark, store)
    assert {r["video_id"]: r["count"] for r in got.groupBy("video_id").count().collect()} == {"7": 3, "007": 5}
    assert fp.read_store(spark, store, "007").count() == 5 and fp.resume_after(got.filter("si < 2"), got).count() == 0
    # Again from the start, without the checkpoint: nothing is written twice.
    si.ingest(spark, str(src), store, str(tmp_path / "other"), files_per_batch=1)
    assert fp.read_store(spark, store).count() == 8


def test_stream_tells_of_progress_stops_and_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"v{k}.ndjson").write_text("\n".join(json.dumps(frame(i)) for i in range(1, 4)) + '\n{"timestamp": 1.0}')
    told = []
    si.ingest(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c"), files_per_batch=1, progress=lambda good, bad: told.append((good, bad)))
    assert told == [(3, 1), (6, 2), (9, 3)]
    with pytest.raises(si.Cancelled):
        si.ingest(spark, str(tmp_path / "in"), str(tmp_path / "s2"), str(tmp_path / "c2"), files_per_batch=1, cancelled=lambda: True)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "w.ndjson").write_text('{"timestamp": 1.0}\n{"timestamp": 2.0}')
    with pytest.raises(RuntimeError, match="all 2 frames"):
        si.ingest(spark, str(tmp_path / "bad"), str(tmp_path / "s3"), str(tmp_path / "c3"))


def test_windowed_counts_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    q = si.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("wc").orderBy("window_start", "event_type").select("window_start", "event_type", "n").collect() == si.windowed_counts(events).orderBy("window_start", "event_type").select("window_start", "event_type", "n").collect()


@pytest.mark.parametrize(("w", "h"), [(1920, 1080), (1080, 1920), (1000, 1000), (3, 5)])
def test_crops_lie_inside(spark, w, h):
    got = image.crop_rects(spark.createDataFrame([(w, h)], "w long, h long")).orderBy("crop_idx").collect()
    assert [r["name"] for r in got] == image.CROPS
    for r in got:
        assert 0 <= r["sx"] and 0 <= r["sy"] and r["sx"] + r["sw"] <= w and r["sy"] + r["sh"] <= h
        assert r["name"] == "full" or r["sx"] % 2 == 0


def brute_subtitles(rgb, force):
    h, w, _ = rgb.shape
    low = int(h * 0.75)
    mask = {(y, x) for y in range(low, h) for x in range(w) if rgb[y, x, 0] > 180 and rgb[y, x, 1] > 180}
    if not force and not 8 <= len(mask) <= w * (h - low) * 0.25:
        return False, rgb
    grown = {(y + a, x + b) for y, x in mask for a in range(-2, 3) for b in range(-2, 3)}
    out = rgb.copy()
    for y in range(h):
        for x in range(w):
            if (y, x) in grown:
                above = next((k for k in range(y - 1, -1, -1) if (k, x) not in grown), None)
                if above is not None:
                    out[y, x] = out[above, x]
    return True, out


def test_subtitles_against_brute_force(spark):
    rng = np.random.default_rng(4)
    frames = [rng.integers(0, 256, (24, 32, 3)).astype(np.uint8) // 2 for _ in range(6)]
    for k, f in enumerate(frames):
        f[20:22, 4 : 4 + 3 * k] = 250
    df = spark.createDataFrame([(i, f.tobytes(), 32, 24) for i, f in enumerate(frames)], "i int, rgb binary, w int, h int")
    for force in (False, True):
        for r in image.remove_subtitles(df, force=force).collect():
            said, out = brute_subtitles(frames[r["i"]], force)
            assert r["has_subtitles"] == said and bytes(r["cleaned"]) == out.tobytes()


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"same": true, "confidence": 120}', (True, 100.0, [])),
        ('x {"same": false, "confidence": 3, "evidence": ["a", " ", "b"]} y', (False, 3.0, ["a", "b"])),
        ('{"same": true, "confidence": 9} {"same": "no", "confidence": 1}', (True, 9.0, [])),
        ('```json\n{"note": "brace } in text", "same": true, "confidence": 50}\n```', (True, 50.0, [])),
        ("{broken", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_verdicts(answer, want):
    assert _verdict(answer) == want


def test_pacer_limits_a_minute_and_a_day(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [("m", k, f"2024-01-15 12:00:{k:02d}") for k in range(6)] + [("m", 6, "2024-01-15 12:01:02"), ("n", 7, "2024-01-15 12:00:00")]
        df = spark.createDataFrame(rows, "model string, request_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(str(tmp_path / "r"))
        q = si.pace(spark.readStream.schema(df.schema).parquet(str(tmp_path / "r")), rpm=3, rpd=4).writeStream.format("memory").queryName("pace").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {r["request_id"]: r["granted"] for r in spark.table("pace").collect()}
    finally:
        spark.conf.unset(key)
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: True}
