"""Scene chunks of a stream: those of the table, however it is split."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cliptrace.operators import frames as fr
from cliptrace.streaming import scenes

ROW = "video_id string, si long, a array<long>, d array<long>, color array<double>, last boolean"


@pytest.fixture(scope="module")
def videos(spark):
    rng = random.Random(6)
    rows = []
    for name, colored in (("a", True), ("b", True), ("c", False), ("one", True)):
        a, d, color = [rng.getrandbits(32) for _ in range(4)], [rng.getrandbits(32) for _ in range(4)], [rng.uniform(0, 255) for _ in range(48)]
        n = 1 if name == "one" else 60
        for k in range(n):
            kind = rng.random()
            if kind < 0.1:
                a = [w ^ 0xFFFFFFFF for w in a]  # all bits change
            elif kind < 0.2:
                d = [w ^ 0xFFFFFFFF for w in d]
            elif kind < 0.3:
                color = [255 - c for c in color]
            rows.append((name, k * (2 if name == "b" else 1), None if kind > 0.95 else a, d, color if colored else None, k == n - 1))
    return rows


def whole(spark, rows):
    cut = fr.scene_cuts(fr.motion(spark.createDataFrame(rows, ROW)))
    n = F.count("*").over(Window.partitionBy("video_id", "chunk_id"))
    numbered = cut.withColumn("chunk_id", F.sum(F.col("is_cut").cast("int")).over(fr.in_order("video_id", "si"))).withColumn("frames", n)
    got = fr.scene_chunks(cut).join(numbered.select("video_id", "chunk_id", "frames").distinct(), ["video_id", "chunk_id"])
    return sorted((r["video_id"], r["chunk_id"], r["start"], r["end"], r["frames"], False) for r in got.collect())


def streamed(spark, batches, folder):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for some in batches:  # each run goes on where the last one ended
            df = spark.createDataFrame(some, ROW)
            df.coalesce(1).write.mode("append").parquet(f"{folder}/r")
            q = scenes.chunk_stream(spark.readStream.schema(df.schema).parquet(f"{folder}/r")).writeStream.format("parquet").option("path", f"{folder}/o")
            q.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    return sorted((tuple(r) for r in spark.read.schema(scenes.OUT).parquet(f"{folder}/o").collect()), key=repr)


@pytest.mark.parametrize("cuts", [[], [13], [5, 6, 31, 50]], ids=["one batch", "two", "five"])
def test_any_split_gives_the_chunks_of_the_table(spark, videos, tmp_path, cuts):
    want = whole(spark, videos)
    assert len(want) > 15
    edges = [0, *cuts, 1_000]
    batches = [random.Random(k).sample(some, len(some)) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if (some := [r for r in videos if lo <= r[1] < hi])]
    assert streamed(spark, batches, str(tmp_path)) == sorted(want, key=repr)


def test_late_frames_and_open_chunks(spark, tmp_path):
    same = ([1], [1], None)
    got = streamed(spark, [[("v", 0, *same, None), ("v", 5, *same, False)], [("v", 3, *same, False), ("v", 6, *same, None)]], str(tmp_path))
    assert got == [("v", None, 3, 3, 1, True)]  # no cut and no last frame: the chunk is still open
    got = streamed(spark, [[("v", 7, [0xFFFFFFFF - 1], [1], None, True)]], str(tmp_path))
    assert ("v", 0, 0, 6, 3, False) in got and ("v", 1, 7, 7, 1, False) in got and len(got) == 3
