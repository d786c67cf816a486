"""Streaming ingest of frame files, and a live request pacer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.fingerprints import FRAME_JSON, pack, write_store


def frame_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Frames of NDJSON files as they arrive; a batch takes a bounded number
    of files, so that a slow sink holds the source back."""
    raw = spark.readStream.schema(FRAME_JSON).option("maxFilesPerTrigger", files_per_batch).option("mode", "DROPMALFORMED").json(folder)
    return raw.withColumn("video_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_fingerprints)?\.(?:nd)?jsonl?$", 1))


class Cancelled(Exception):
    """An ingest was stopped between batches; what is stored stays."""


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, bad: str | None = None, files_per_batch: int = 16,
           progress: Callable[[int, int], None] | None = None, cancelled: Callable[[], bool] | None = None):
    """Run what has arrived into the Parquet store and stop.

    Frames already stored are not written again, whatever broke off before;
    frames without an index or hashes go to ``bad``.  ``progress`` is called
    after each batch with the frames taken and those left out so far;
    ``cancelled`` is asked before each and ends the run with ``Cancelled``.  A run
    of which every frame is left out is an error.
    """
    done = {"good": 0, "bad": 0, "stopped": False}

    def write(batch: DataFrame, epoch: int) -> None:
        if done["stopped"] or cancelled is not None and cancelled():
            done["stopped"] = True
            raise Cancelled(folder)
        batch = batch.persist()
        good = F.col("frameIndex").isNotNull() & F.col("variants").isNotNull() & (F.size("variants") > 0)
        if bad:
            batch.filter(~good).withColumn("epoch", F.lit(epoch)).write.mode("append").json(bad)
        frames = pack(batch.filter(good))
        # A batch has as many videos as files, at most: only their part of the store is read.
        videos = [r["video_id"] for r in batch.select("video_id").distinct().collect()]
        try:
            have = spark.read.schema("video_id string, si long").parquet(store).filter(F.col("video_id").isin(videos))
            frames = frames.join(have, ["video_id", "si"], "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        write_store(frames, store)
        counts = batch.agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad")).first()
        done["good"] += counts["good"]
        done["bad"] += counts["bad"]
        batch.unpersist()
        if progress is not None:
            progress(done["good"], done["bad"])

    stream = frame_stream(spark, folder, files_per_batch)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if done["stopped"]:
            raise Cancelled(folder) from None
        raise
    if done["bad"] and not done["good"]:
        raise RuntimeError(f"all {done['bad']} frames were left out")
    return query


def windowed_counts(events: DataFrame, at: str = "ts", key: str = "event_type", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per tumbling window and key, with a watermark; the same
    plan serves a stream and a table."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


class Pacer(StatefulProcessor):
    """Grants requests of a model while fewer than ``rpm`` lie within the last
    minute and fewer than ``rpd`` within the day; (model, request_id, granted)."""

    def __init__(self, rpm: int, rpd: int):
        self.rpm, self.rpd = rpm, rpd

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at long")
        self.day = handle.getValueState("day", "day string, used long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        recent = [r[0] for r in self.recent.get()]
        day, used = self.day.get() if self.day.exists() else ("", 0)
        out = []
        for batch in rows:
            for at, today, request in batch.sort_values("at")[["at", "day", "request_id"]].itertuples(index=False):
                recent = [t for t in recent if at - t < 60_000]
                if today != day:  # a new day starts with an empty minute
                    day, used, recent = today, 0, []
                ok = len(recent) < self.rpm and used < self.rpd
                if ok:
                    recent.append(int(at))
                    used += 1
                out.append((key[0], int(request), ok))
        self.recent.put([(t,) for t in recent])
        self.day.update((day, used))
        yield pd.DataFrame(out, columns=["model", "request_id", "granted"])

    def close(self) -> None:
        pass


def pace(requests: DataFrame, rpm: int = 15, rpd: int = 500) -> DataFrame:
    """Grants for a stream of requests (model, request_id, ts)."""
    rows = requests.select("model", "request_id", F.unix_millis("ts").alias("at"), F.to_date(F.from_utc_timestamp("ts", "America/Los_Angeles")).cast("string").alias("day"))
    return rows.groupBy("model").transformWithStateInPandas(Pacer(rpm, rpd), "model string, request_id long, granted boolean", "Append", "None")
