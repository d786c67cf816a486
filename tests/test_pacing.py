"""Rotation over two models: as a stream, over a table, and by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cliptrace.streaming import pacing

ROW = "caller string, ts timestamp, kind string, request_id long, model string, retry_ms long"
T0 = 1_705_320_000_000  # 2024-01-15 12:00 UTC, 04:00 in the zone of the limits


def taken(rows, rpm=3, rpd=100, probe_ms=1_800_000):
    state, out = pacing.Rotation(rpm, rpd, probe_ms), {}
    for at, kind, request, model, retry in rows:
        out |= {r: (m, t - T0, o) for r, m, t, o in state.take(T0 + at, kind, request, model, retry)}
    return state, out, {r: (m, t - T0, o) for r, m, t, o in state.until(1 << 62)}


def test_six_quick_requests_go_three_and_three_without_a_wait():
    _, out, rest = taken([(k, "request", k, None, None) for k in range(6)])
    assert [out[k][:2] for k in range(6)] == [("primary", k) for k in range(3)] + [("fallback", k) for k in range(3, 6)] and not rest


def test_the_seventh_waits_for_the_model_that_is_free_first():
    _, out, rest = taken([(k * 1_000, "request", k, None, None) for k in range(8)])
    assert len(out) == 6 and rest == {6: ("primary", 60_250, "granted"), 7: ("primary", 61_250, "granted")}
    # in order, also behind a request that waits
    _, out, rest = taken([(k, "request", k, None, None) for k in range(7)] + [(60_200, "request", 7, None, None)])
    assert rest[6][1] <= rest[7][1]


def test_daily_refusals_park_and_are_skipped_without_a_request():
    rows = [(0, "request", 0, None, None), (10, "daily_limit", 0, "primary", None), (20, "request", 1, None, None), (30, "request", 2, None, None)]
    state, out, _ = taken(rows)
    assert [out[k][0] for k in (0, 1, 2)] == ["primary", "fallback", "fallback"] and state.models[0].parked and not state.models[1].parked
    state, out, _ = taken([*rows, (40, "daily_limit", 2, "fallback", None), (50, "request", 3, None, None), (1_800_050, "request", 4, None, None), (1_800_060, "request", 5, None, None)])
    assert out[3] == (None, 50, "unavailable") and out[4] == ("primary", 1_800_050, "probe") and out[5][2] == "unavailable"
    back = [*rows, (40, "daily_limit", 2, "fallback", None), (1_800_050, "request", 4, None, None), (1_800_900, "ok", 4, "primary", None), (1_801_000, "request", 5, None, None)]
    assert taken(back)[1][5] == ("primary", 1_801_000, "granted")


def test_minute_refusals_cool_one_model_down():
    rows = [(0, "request", 0, None, None), (10, "minute_limit", 0, "primary", 5_000), (20, "request", 1, None, None), (5_010, "request", 2, None, None)]
    assert [taken(rows)[1][k][0] for k in (1, 2)] == ["fallback", "primary"]
    both = [(0, "minute_limit", 0, "primary", 90_000), (0, "minute_limit", 0, "fallback", 200_000), (5, "request", 1, None, None)]
    assert taken(both)[2] == {1: ("primary", 90_000, "granted")}


def test_a_new_day_clears_windows_parking_and_cooling():
    midnight = 20 * 3_600_000  # 08:00 UTC of the next day
    rows = [(midnight - 100 + k, "request", k, None, None) for k in range(6)] + [(midnight - 50, "daily_limit", 0, "fallback", None), (midnight - 40, "minute_limit", 1, "primary", 900_000), (midnight + 1, "request", 6, None, None)]
    assert taken(rows)[1][6] == ("primary", midnight + 1, "granted")
    _, out, rest = taken([(midnight - 100 + k, "request", k, None, None) for k in range(7)])
    assert rest[6] == ("primary", midnight - 100 + 60_250, "granted")
    _, out, rest = taken([(k, "request", k, None, None) for k in range(4)], rpm=9, rpd=1)
    assert [x[2] for x in (out | rest).values()] == ["granted", "granted", "probe", "unavailable"]


def test_table_equals_stream(spark, tmp_path):
    """Also over several batches, with a restart between them."""
    rows = [("a", k * 700, "request", k, None, None) for k in range(20)] + [("b", 50 * k, "request", 100 + k, None, None) for k in range(3)]
    rows += [("a", 2_000, "minute_limit", 2, "fallback", 20_000), ("a", 9_000, "daily_limit", 5, "primary", None)]
    last = [("a", 900_000, "minute_limit", 0, "fallback", 0), ("b", 900_000, "minute_limit", 0, "fallback", 0)]
    made = lambda some: spark.createDataFrame([(c, at, *x) for c, at, *x in some], "caller string, at long, kind string, request_id long, model string, retry_ms long").withColumn("ts", F.timestamp_millis(F.lit(T0) + F.col("at"))).select("caller", "ts", "kind", "request_id", "model", "retry_ms")
    want = sorted(tuple(r) for r in pacing.pace_table(made(rows + last), 3, 100).collect())
    assert len(want) == 23 and {w[2] for w in want} == {"primary", "fallback"}
    by_hand = []
    for caller in "ab":
        state = pacing.Rotation(3, 100, pacing.PROBE_MS)
        mine = sorted((r for r in rows + last if r[0] == caller), key=lambda r: (r[1], r[2] == "request", r[3]))
        for _, at, kind, request, model, retry in mine:
            by_hand += [(caller, *x) for x in state.take(T0 + at, kind, request, model, retry)]
        by_hand += [(caller, *x) for x in state.until(1 << 62)]
    assert sorted(by_hand) == want
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        ordered = sorted(rows, key=lambda r: r[1])
        got = {}
        for n, some in enumerate([ordered[:9], ordered[9:], last, [(c, 2_000_000, *x) for c, _, *x in last]]):
            made(some).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
            stream = pacing.pace_stream(spark.readStream.schema(made(some).schema).parquet(str(tmp_path / "r")), 3, 100)
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
        got = sorted(tuple(r) for r in spark.read.schema(pacing.OUT).parquet(str(tmp_path / "o")).collect())
    finally:
        spark.conf.unset(key)
    assert got == want


def test_empty_tables(spark):
    assert pacing.pace_table(spark.createDataFrame([], ROW)).count() == 0


@pytest.mark.parametrize(("ms", "day"), [(1_705_305_599_999, "2024-01-14"), (1_705_305_600_000, "2024-01-15"), (1_720_000_000_000, "2024-07-03")])
def test_pacific_day(ms, day):
    assert pacing.pacific_day(ms) == day


def test_serving_takes_time_in_proportion_to_those_that_wait():
    """Half a million wait for a day that is used up; the first of them goes as
    quickly as the last."""
    import pickle
    import time

    rotation = pacing.Rotation(3, 0, 1 << 50)
    rotation.queue.extend(range(500_000))
    began = time.process_time()
    out = rotation.until(1_705_305_600_000)
    took = time.process_time() - began
    assert len(out) == 500_000 and [x[0] for x in out[:3]] == [0, 1, 2] and {x[3] for x in out} == {"unavailable"}
    rotation.queue.extend(range(10_000))
    began = time.process_time()
    rotation.until(1_705_305_600_000)
    assert took < 50 * 4 * (time.process_time() - began)
    # States that hold a list are read as before.
    old = pacing.Rotation(3, 10, 1 << 50)
    old.__dict__["queue"] = [5, 6]
    assert [x[0] for x in pickle.loads(pickle.dumps(old)).until(1_705_305_600_000)] == [5, 6]
