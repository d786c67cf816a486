"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(col.cast("string")) % F.lit(mod)


def drawn(hashed: Column, wanted: int, rows: int) -> Column:
    """Whether a row, by a hash of it, is in a sample of about ``wanted`` of
    ``rows`` rows.  Nothing is shuffled for it."""
    return F.pmod(hashed, F.lit(1_000_000_007)) < F.lit(min(1_000_000_007, wanted * 1_000_000_007 // max(rows, 1)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session is used as it is.  Only where a
    session on a single machine names none (tests), a temporary folder is set;
    on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="cliptrace-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path.

    The rows are computed once, a lost executor costs no recomputation of what
    lies before, and the table's size is known to the planner.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage by a table in the shared folder."""
    return written(df)[0]


#: Tables written and not yet removed, the oldest first.
_tables: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end the tables that were written inside: for a caller who
    then has written down all that is to stay."""
    known = len(_tables)
    try:
        yield
    finally:
        for path in _tables[known:]:
            remove(spark, path)
        del _tables[known:]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_bytes(spark: SparkSession, value: object, size: int, limit: int, what: str):
    """Broadcast ``value``, whose serialized size ``size`` has been measured
    and must not be over ``limit``."""
    if size > limit:
        raise ValueError(f"{what}: {size} bytes exceed the broadcast bound of {limit}")
    return spark.sparkContext.broadcast(value)


def parts_for(rows: int, per_part: int, least: int = 8) -> int:
    """Partitions so that each gets about ``per_part`` rows."""
    return max(least, math.ceil(rows / per_part))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any letter case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name


_kept: dict[Any, Any] = {}


def only(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this Python worker between tasks.

    A worker serves one stage after another and keeps one such value at a time:
    asking for another one gives the memory of the last back to the system.
    """
    if key not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library
        _kept[key] = make()
    return _kept[key]
