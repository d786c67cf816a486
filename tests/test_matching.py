"""Matching on synthetic frames: known alignments, histories, retries."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptrace.operators import intervals as iv
from cliptrace.operators import verification as ve
from cliptrace.plans import match as plan
from cliptrace.plans import retry as rt
from cliptrace.functions.blocks import Frames, Layout
from cliptrace.plans.align import CANDIDATE, MAIN, Aligner

from . import plain_matching as plain

FRAME = "video_id string, si long, ts double, variants array<struct<name string, a array<long>, d array<long>, fa array<long>, fd array<long>, p array<long>>>, color array<double>, skin array<double>, detail array<double>"


def lcg(seed=42):
    s = seed
    while True:
        s = (s * 1664525 + 1013904223) % 2**32
        yield s / 2**32


def noise(r):
    return [1 if next(r) > 0.5 else 0 for _ in range(256)]


def coverage_frames():
    """A pattern of 80 frames, one bit flipped in each, inside noise at 100."""
    r = lcg()
    pattern, now = [], noise(r)
    for _ in range(80):
        now = list(now)
        now[int(next(r) * 256)] ^= 1
        pattern.append(now)
    movie = [noise(r) for _ in range(100)] + pattern + [noise(r) for _ in range(70)]
    return pattern, movie


def rows(video, frames):
    def words(bits):
        return [sum(b << k for k, b in enumerate(bits[w : w + 32])) for w in range(0, 256, 32)]

    return [(video, i, i / 25.0, [("full", words(b), None, None, None, None)], None, None, None) for i, b in enumerate(frames)]


@pytest.fixture(scope="module")
def clip(spark):
    short, movie = coverage_frames()
    return spark.createDataFrame(rows("short", short), FRAME).cache(), spark.createDataFrame(rows("movie", movie), FRAME).cache()


@pytest.mark.parametrize("profile", [MAIN, CANDIDATE])
def test_coverage(clip, profile):
    got = plan.match(*clip, profile, 82, 9, 3)
    seg = got.segments.collect()
    assert len(seg) == 1 and seg[0]["frame_count"] == 80 and abs(seg[0]["movie_start"] - 4.0) < 0.5
    assert abs(seg[0]["short_end"] - 80 / 25) < 1e-9 and seg[0]["confidence"] == pytest.approx(100)
    assert got.unmatched.count() == 0
    for a in got.alternates.collect():
        assert a["frame_count"] == 80 and a["movie_end"] != a["movie_start"]
    pool = got.alternates
    asked = pool.sparkSession.createDataFrame([("short", 1, 0.0, 3.2)], "match_id string, range_id long, r_start double, r_end double")
    rejected = pool.sparkSession.createDataFrame([("short", 1, 4.0)], "match_id string, range_id long, x_start double")
    assert all(abs(r["movie_start"] - 4.0) > 0.5 for r in iv.alternates(pool, asked, rejected).collect())


def test_order_and_partitions_do_not_matter(clip):
    short, movie = clip
    one = plan.match(short, movie, MAIN).segments.collect()
    two = plan.match(short.repartition(7).orderBy(F.rand(3)), movie.repartition(5).orderBy(F.rand(1)), MAIN).segments.collect()
    assert one == two


def test_groups_and_blocks_do_not_matter(clip, spark, monkeypatch):
    one = plan.match(*clip, MAIN).segments.collect()
    monkeypatch.setattr(plan, "SHORT_FRAMES", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)  # many blocks of the movie
    try:
        assert plan.match(*clip, MAIN).segments.collect() == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def colored(rng, n, scenes):
    """Frames with three variants, all channels and slowly changing grids."""
    out, color, bits = [], None, None
    for k in range(n):
        if k % scenes == 0 or color is None:
            color, bits = rng.integers(0, 256, 48).astype(float), {c: rng.integers(0, 2, (3, b)) for c, b in (("a", 64), ("d", 96), ("fa", 64), ("fd", 96), ("p", 64))}
        color = np.clip(color + rng.normal(0, 2, 48), 0, 255)
        bits = {c: x ^ (rng.random(x.shape) < 0.03) for c, x in bits.items()}
        words = lambda x: [int(sum(int(b) << j for j, b in enumerate(x[w : w + 32]))) for w in range(0, len(x), 32)]
        variants = [{"name": name, **{c: words(bits[c][v]) for c in bits}} for v, name in enumerate(("full", "crop", "zoom"))]
        out.append({"variants": variants, "color": color.tolist(), "skin": rng.random(16).tolist(), "detail": (rng.random(16) * 30).tolist()})
    return out


def edited(rng, movie, spans, rate, turned=False):
    """Spans of the movie (start, frames, step), a little changed, one after another."""
    out = []
    for start, n, step in spans:
        for k in range(n):
            f = movie[min(len(movie) - 1, int(start + k * step))] if start is not None else colored(rng, 1, 1)[0]
            noisy = [{**v, **{c: [w ^ (1 << int(rng.integers(0, 32))) if rng.random() < 0.3 else w for w in v[c]] for c in ("a", "d", "p")}} for v in f["variants"]]
            if turned:
                noisy = [{**v, "a": v["fa"], "d": v["fd"], "fa": v["a"], "fd": v["d"]} for v in noisy]
            out.append({**f, "variants": noisy, "color": np.clip(np.array(f["color"]) + rng.normal(0, 1.5, 48), 0, 255).tolist(), "ts": len(out) / rate})
    return out


@pytest.mark.parametrize("profile", ["main", "candidate"])
def test_matching_equals_plain_loops(spark, profile):
    rng = np.random.default_rng(12)
    movie = [f | {"ts": k / 25} for k, f in enumerate(colored(rng, 210, 35))]
    shorts = {
        "a": edited(rng, movie, [(20, 24, 1), (120, 18, 2), (None, 14, 1), (60, 16, 1)], 25),
        "b": edited(rng, movie, [(150, 20, 0.5), (5, 12, 1)], 10, turned=True),
        "c": [{**f, "color": None, "skin": None, "detail": None} for f in edited(rng, movie, [(90, 15, 1), (None, 12, 1), (40, 5, 1)], 30)],
    }
    rows = lambda name, video: [(name, k, f["ts"], [tuple(v[c] for c in ("name", "a", "d", "fa", "fd", "p")) for v in f["variants"]], f["color"], f["skin"], f["detail"]) for k, f in enumerate(video)]
    short = spark.createDataFrame([r for n, v in shorts.items() for r in rows(n, v)], FRAME)
    got = plan.match(short, spark.createDataFrame(rows("m", movie), FRAME), {"main": MAIN, "candidate": CANDIDATE}[profile])
    # The same whatever the groups; one movie of a library is that movie.
    times = ("short_start", "short_end", "movie_start", "movie_end", "confidence", "speed_ratio")
    flat = lambda x: [*(round(x[c], 6) for c in times), x["frame_count"], x["gap_count"], x["is_approximate"]]
    found, free, pool, everything = (getattr(got, n).collect() for n in ("segments", "unmatched", "alternates", "pool"))
    n_segments = n_merged = 0
    for name, video in shorts.items():
        want, want_free, want_pool, want_merged = plain.whole(video, movie, profile)
        mine = sorted((x for x in found if x["match_id"] == name), key=lambda x: x["short_start"])
        assert [flat(x) for x in mine] == [flat(x) for x in want], name
        for x, y in zip(mine, want, strict=True):
            d = x["detail"]
            assert d["crop"] == y["detail"][0]
            assert [d[c] for c in ("structure_sim", "color_sim", "skin_sim", "detail_sim")] == pytest.approx(y["detail"][1:])
            assert d["short_hash"] == video[x["best_si"]]["variants"][0]["a"] and d["movie_hash"] == movie[x["best_mi"]]["variants"][0]["a"]
        assert sorted((round(u["short_start"], 6), round(u["short_end"], 6), u["frames"]) for u in free if u["video_id"] == name) == [(round(a, 6), round(b, 6), n) for a, b, n in want_free]
        alternates = [x for x in pool if x["match_id"] == name]
        assert sorted(flat(x) for x in alternates) == sorted(flat(x) for x in want_pool)
        steps = lambda x: [(p["si"], p["mi"], round(p["similarity"], 6)) for p in x["sequence"]]
        assert sorted(map(steps, alternates)) == sorted([(a, b, round(c, 6)) for a, b, c in x["seq"]] for x in want_pool)
        assert sorted(flat(x) for x in everything if x["match_id"] == name) == sorted(flat(x) for x in [*want_merged, *want_pool])
        n_segments, n_merged = n_segments + len(want), n_merged + len(want_merged)
    assert n_segments >= 6 and pool


def test_library_matches_each_movie(clip, spark):
    short, movie = clip
    noise_only = movie.filter("si < 90").withColumn("video_id", F.lit("other"))
    got = plan.match(short.unionByName(short.withColumn("video_id", F.lit("again"))), movie.unionByName(noise_only), MAIN, single=False)
    ids = {r["match_id"]: r for r in got.segments.filter("NOT is_approximate").collect()}
    assert set(ids) == {"short/movie", "again/movie"} and ids["short/movie"]["frame_count"] == 80
    assert {r["match_id"] for r in got.unmatched.collect()} <= {"short/other", "again/other"}
    one = plan.match(short, movie, MAIN).segments.first()
    assert all(ids["short/movie"][c] == one[c] for c in ("movie_start", "movie_end", "short_end", "confidence", "detail"))


def test_merge_keeps_the_detail_of_the_running_confidence(spark):
    rows = [("m", k, k * 1.0, k + 1.0, k * 1.0, k + 1.0, c, 10, 0, 1.0, False) for k, c in enumerate([90.0, 50.0, 80.0])]
    df = spark.createDataFrame(rows, "match_id string, seg_id long, short_start double, short_end double, movie_start double, movie_end double, confidence double, frame_count int, gap_count int, speed_ratio double, is_approximate boolean")
    r = iv.merge_adjacent(df).collect()
    assert len(r) == 1 and r[0]["detail_seg_id"] == 2 and r[0]["members"] == [0, 1, 2]


def test_folds_equal_plain_loops(spark):
    """One busy match, repeated places, ties, and rows without a place."""
    rng = random.Random(4)
    rows = [("m" if rng.random() < 0.9 else f"n{k % 3}", k, round(rng.uniform(0, 400), 1), rng.choice([0.05, 1.0, 40.0]), rng.choice([60.0, 70.0, 80.0])) for k in range(1_500)]
    rows += [("m", 2_000, None, 1.0, 90.0), ("m", 2_001, None, 1.0, 90.0), ("n0", 2_002, float("nan"), 1.0, 90.0)]
    df = spark.createDataFrame(rows, "match_id string, seg_id long, short_start double, length double, confidence double").repartition(7)
    df = df.withColumns({"short_end": F.col("short_start") + F.col("length"), "movie_start": F.col("short_start")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        ranges = {(r["match_id"], r["kept_idx"]): r["seg_id"] for r in iv.overlap_dedup(df).collect()}
        places = {(r["match_id"], r["kept_idx"]): r["seg_id"] for r in iv.near_dedup(df, ["match_id"], [F.col("seg_id")], ["seg_id", "movie_start"], limit=9).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    placed = lambda r: r[2] is not None and r[2] == r[2]

    def greedy(order, clash, limit=None):
        kept = {}
        for r in sorted(rows, key=order):
            mine = kept.setdefault(r[0], [])
            if (limit is None or len(mine) < limit) and not (placed(r) and any(placed(k) and clash(r, k) for k in mine)):
                mine.append(r)
        return {(m, n): r[1] for m, mine in kept.items() for n, r in enumerate(mine)}

    assert ranges == greedy(lambda r: (-r[4], r[1]), lambda x, k: min(x[2] + x[3], k[2] + k[3]) - max(x[2], k[2]) > 0.15)
    assert places == greedy(lambda r: r[1], lambda x, k: abs(x[2] - k[2]) <= 0.5, 9)


def test_every_tried_candidate_is_an_attempt(spark):
    rows = [(1, k, None if k <= 10 else True, 90.0) for k in range(1, 12)] + [(2, 1, None, None), (2, 2, True, 95.0)] + [(3, k, False, 99.0) for k in range(1, 4)] + [(4, 1, None, None)]
    df = spark.createDataFrame(rows, "set_id long, rank int, same boolean, confidence_pct double")
    got = {r["set_id"]: (r["attempts"], r["accepted_rank"], r["outcome"]) for r in ve.verify(df, ["set_id"]).collect()}
    assert got == {1: (10, None, "inconclusive"), 2: (2, 2, "accepted"), 3: (3, None, "rejected"), 4: (1, None, "inconclusive")}
    sets = spark.createDataFrame([(1, True)], "set_id long, dropped boolean")
    put_off = df.filter("set_id = 1").selectExpr("set_id", "rank AS ord", "same", "confidence_pct", "false AS checked", "CAST(NULL AS STRING) AS verdict")
    r = ve.deferred_pass(put_off, sets).first()
    assert (r["attempts"], r["accepted_rank"], r["outcome"]) == (11, 11, "accepted")


def test_keep_best_takes_checked_candidates_only(spark):
    sets = spark.createDataFrame([(1, 1, 0.0, 1.0, True), (2, 1, 5.0, 6.0, True)], "set_id long, match_id long, r_start double, r_end double, dropped boolean")
    made = "set_id long, cand_idx long, checked boolean, verdict string, confidence_pct double"
    candidates = spark.createDataFrame([(1, 0, False, None, 99.0), (2, 0, False, None, 99.0), (2, 1, True, "rejected", None), (2, 2, True, "rejected", 10.0), (2, 3, True, "rejected", 10.0)], made)
    nothing = spark.createDataFrame([], "match_id long, short_start double, short_end double")
    assert [(r["set_id"], r["cand_idx"]) for r in iv.keep_best_dropped(candidates, sets, nothing).collect()] == [(2, 2)]


def test_noise_is_approximate_at_most(spark):
    r = lcg(7)
    short, movie = ([noise(r) for _ in range(n)] for n in (30, 90))
    got = plan.match(spark.createDataFrame(rows("s", short), FRAME), spark.createDataFrame(rows("m", movie), FRAME), MAIN)
    found = got.segments.collect()
    assert all(s["is_approximate"] and s["confidence"] < 80 for s in found)
    free = got.unmatched.collect()
    assert sum(u["frames"] for u in free) + sum(s["frame_count"] for s in found) >= 30
    empty = plan.match(spark.createDataFrame(rows("s", short), FRAME), spark.createDataFrame([], FRAME), MAIN)
    assert empty.segments.count() == 0 and empty.unmatched.agg(F.sum("frames")).first()[0] == 30


def hashed(n, **channels):
    """Frames of one variant with these hashes (frame x word)."""
    none = {g: (np.zeros((n, w)), np.zeros(n, bool)) for g, w in (("color", 48), ("skin", 16), ("detail", 16))}
    words = {c: x.shape[1] for c, x in channels.items()}
    return Frames(np.arange(n), np.arange(n) / 25, {c: np.ascontiguousarray(x).view(np.uint64)[:, None] for c, x in channels.items()}, Layout(["full"], words), none)


def test_mirrored_and_sped_up_clips():
    rng = np.random.default_rng(1)
    base, other = (rng.integers(0, 2**32, (200, 8), np.uint64).astype(np.uint32) for _ in range(2))
    segments, _ = Aligner(hashed(40, a=base[60:100]), hashed(200, a=other, fa=base), np.zeros(41, bool), MAIN, 3).chunk((0, 39), 82, 9)
    assert [x[1] for x in segments[0]["seq"]] == list(range(60, 100))
    aligner = Aligner(hashed(40, a=base[20:100:2]), hashed(200, a=base), np.zeros(41, bool), MAIN, 3)
    segments, _ = aligner.chunk((0, 39), 82, 9)
    assert [x[1] for x in segments[0]["seq"]] == list(range(20, 100, 2))
    assert aligner.summary(segments[0]["seq"])["speed_ratio"] == pytest.approx(2.0)


def history(spark, tried, extras, dropped=False):
    make = lambda rows: spark.createDataFrame(rows, "set_id long, ord long, movie_start double")
    sets = spark.createDataFrame([(1, dropped)], "set_id long, dropped boolean")
    return ve.candidate_history(make([(1, k, float(m)) for k, m in enumerate(tried)]), make([(1, 100 + k, float(m)) for k, m in enumerate(extras)]), sets).orderBy("cand_idx").collect()


def test_candidate_history(spark):
    first = history(spark, [10], [20, 30])
    assert len(first) == 3 and first[0]["accepted_idx"] == 0 and [r["checked"] for r in first] == [True, False, False]
    third = history(spark, [10, 20, 30], [40])
    assert len(third) == 4 and third[0]["accepted_idx"] == 2
    lost = history(spark, [10, 20], [30], dropped=True)
    assert len(lost) == 3 and lost[0]["accepted_idx"] is None
    assert history(spark, [], []) == []
    assert len(history(spark, [10], range(20, 60, 2))) == 11


def test_fresh_leaves_near_places_out(spark):
    made = "set_id long, ord long, movie_start double"
    got = ve.fresh(spark.createDataFrame([(1, 0, 10.1), (1, 1, 12.0), (2, 2, 10.0)], made), spark.createDataFrame([(1, 0, 10.0)], made))
    assert sorted(r["ord"] for r in got.collect()) == [1, 2]


def test_retry(clip, spark):
    short, movie = clip
    pool = plan.match(short, movie, CANDIDATE).alternates.limit(1).withColumn("movie_start", F.lit(50.0))
    right = lambda c: c.withColumn("same", F.abs(F.col("movie_start") - 4.0) < 0.5).withColumn("confidence_pct", F.lit(90.0))
    got = rt.retry(short, movie, pool, 0.0, 3.2, right)
    assert got.outcome == "accepted" and abs(got.candidate["movie_start"] - 4.0) < 0.5 and got.rounds >= 1 and got.attempts >= 2
    never = lambda c: c.withColumn("same", F.lit(False)).withColumn("confidence_pct", 60.0 + F.col("rank"))
    got = rt.retry(short, movie, pool, 0.0, 3.2, never, budget=2)
    assert got.outcome == "best_effort" and got.attempts == 2
    down = lambda c: c.withColumn("same", F.lit(None).cast("boolean")).withColumn("confidence_pct", F.lit(0.0))
    assert rt.retry(short, movie, pool, 0.0, 3.2, down, most_rounds=1).outcome == "exhausted"
    assert [rt.params(r)["min_similarity"] for r in (0, 1, 9)] == [40, 35, 20]


def test_merged_segments_as_confident_as_the_first_do_not_take_its_place(spark):
    """The running mean of one segment is its confidence, to the last bit."""
    from cliptrace.operators import intervals as iv

    even = [c for c in (k / 1_000 for k in range(1, 4_000)) if c * 7 / 7 < c][:5] + [c for c in (k / 1_000 for k in range(1, 4_000)) if c * 11 / 11 < c][:5]
    made = [(m, 10 * m + k, k * 0.4, k * 0.4 + 0.4, k * 0.4, k * 0.4 + 0.4, c, f, 0, 1.0, False) for m, c in enumerate(even) for k, f in enumerate((7 if m < 5 else 11, 3))]
    kind = "match_id long, seg_id long, short_start double, short_end double, movie_start double, movie_end double, confidence double, frame_count int, gap_count int, speed_ratio double, is_approximate boolean"
    got = iv.merge_adjacent(spark.createDataFrame(made, kind)).collect()
    assert len(even) and {(r["match_id"], r["detail_seg_id"], tuple(r["members"])) for r in got} == {(m, 10 * m, (10 * m, 10 * m + 1)) for m in range(len(even))}


def test_kept_candidates_of_ids_far_apart_are_those_of_the_sql(spark, tmp_path):
    """A candidate a little more confident, but far down in the list."""
    import duckdb

    from cliptrace.queries import QUERIES, SQL

    made = spark.createDataFrame([(2, 0, 250.0), (120_002, 0, 250.05), (3, 0, 250.0), (120_006, 1, 250.0), (6, 1, 249.0)], "event_id long, user_id long, value double")
    made.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"SELECT match_id, set_id, cand_idx FROM ({SQL['keep_best_dropped']})").fetchall()
    got = QUERIES["keep_best_dropped"](spark, str(tmp_path)).select("match_id", "set_id", "cand_idx").collect()
    assert (0, 2, 2) in want and sorted(map(tuple, got)) == sorted(want)
