"""A match that runs beside its caller."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from cliptrace.plans import match as plan
from cliptrace.plans.running import PHASES, Running

from .test_matching import FRAME, clip, lcg, noise, rows  # noqa: F401  clip: a fixture


def test_phases_and_tables(spark, clip, tmp_path):  # noqa: F811
    seen = []
    job = Running(*clip, str(tmp_path), progress=lambda s: seen.append((s.phase, s.share)))
    end = job.wait(600)
    assert (end.state, end.phase, end.share, end.error) == ("completed", "done", 1.0, None) and end.tasks > 0
    assert [p for p, _ in seen] == ["alignment", "unmatched", "alternates", "pool", "done"] and [x for _, x in seen] == sorted(x for _, x in seen)
    got = plan.match(*clip)
    for part in ("segments", "alternates", "pool"):
        assert spark.read.parquet(f"{tmp_path}/{part}").count() == getattr(got, part).count()
    got.release()
    job.cancel()
    assert job.status().state == "completed"


def test_cancel_ends_the_tasks(spark, tmp_path):
    r = lcg(3)
    short, movie = (spark.createDataFrame(rows(n, [noise(r) for _ in range(k)]), FRAME) for n, k in (("s", 150), ("m", 500)))
    slow = movie.withColumn("ts", F.udf(lambda t: time.sleep(0.5) or t, "double")("ts"))  # four minutes of it
    job = Running(short, slow, str(tmp_path))
    began = time.time()
    while not job.status().tasks and time.time() - began < 60:
        time.sleep(0.2)
    job.cancel()
    end = job.wait(60)
    assert (end.state, end.phase, end.error) == ("cancelled", "alignment", None) and end.share < PHASES["segments"]
    tracker = spark.sparkContext.statusTracker()
    while any(tracker.getJobInfo(j).status == "RUNNING" for j in tracker.getJobIdsForGroup(job.group)) and time.time() - began < 100:
        time.sleep(0.2)
    assert not any(tracker.getJobInfo(j).status == "RUNNING" for j in tracker.getJobIdsForGroup(job.group))


def test_errors_are_told(spark, clip, tmp_path):  # noqa: F811
    job = Running(clip[0], clip[1].drop("variants"), str(tmp_path))
    end = job.wait(120)
    assert end.state == "failed" and "variants" in end.error and set(PHASES) >= {end.phase}
