"""Histories of jobs: listing, identity, progress, recovery after a restart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of states in a list.
STATUS_RANK = {"processing": 0, "queued": 1, "completed": 2, "stopped": 3, "failed": 4}


def status_rank(status: Column) -> Column:
    """Place of a state in a list; unknown ones last."""
    out = F.lit(len(STATUS_RANK))
    for name, n in STATUS_RANK.items():
        out = F.when(status == name, n).otherwise(out)
    return out


def job_list(videos: DataFrame, matches: DataFrame) -> DataFrame:
    """Both kinds of jobs (job_id, name, status, started_at) as one list, with
    ``kind`` and ``position``: running ones first, then the newest."""
    both = videos.withColumn("kind", F.lit("video")).unionByName(matches.withColumn("kind", F.lit("match")))
    return both.withColumn("state_rank", status_rank(F.col("status"))).orderBy("state_rank", F.desc("started_at"), "kind", "job_id")


def identity(name: Column, size: Column) -> Column:
    """Key under which a file is known."""
    return F.concat(name, F.lit(":"), size.cast("string"))


def duplicates(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads (upload_id, name, size) with the latest finished job of the same
    identity, if any."""
    done = known.filter("status = 'completed'").groupBy(identity(F.col("name"), F.col("size")).alias("_k")).agg(F.max_by("job_id", F.struct("started_at", "job_id")).alias("known_job"))
    return uploads.withColumn("_k", identity(F.col("name"), F.col("size"))).join(done, "_k", "left").drop("_k")


def progress(jobs: DataFrame) -> DataFrame:
    """Add ``fps``, ``eta_seconds`` and ``pct`` from (done, total, elapsed)."""
    fps = F.when(F.col("elapsed") > 0, F.col("done") / F.col("elapsed")).otherwise(0.0)
    return jobs.withColumns({
        "fps": fps,
        "eta_seconds": F.when(fps > 0, (F.col("total") - F.col("done")) / F.when(fps > 0, fps)),
        "pct": F.when(F.col("total") > 0, F.least(F.lit(100.0), F.col("done") * 100.0 / F.when(F.col("total") > 0, F.col("total")))).otherwise(0.0),
    })


def recovered_status(meta: Column, has_result: Column, has_checkpoint: Column) -> Column:
    """State of a job after a restart, from its stored state and the files
    that exist; null where nothing is known."""
    return (
        F.when(meta.isin("stopped", "failed"), meta)
        .when(has_result & ~has_checkpoint, "completed")
        .when(has_checkpoint, "failed")
        .when(meta.isNotNull(), "failed")
    )


def recovered_match(status: Column) -> Column:
    """State of a match after a restart: what was running has failed."""
    return F.when(status == "processing", "failed").otherwise(status)
