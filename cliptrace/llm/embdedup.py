"""Near-duplicate vectors: sign hashing, exact cosines, components.

Signs of random projections hash each distinct vector into several tables.
Vectors that share a bucket are compared exactly, in double precision and in
blocks; a pair counts in the first table where it meets, so that links are
counted without ever listing pairs.  Each block returns a spanning forest of
its links, and components are joined from these.

Bits follow the number of vectors (about ``BUCKET_ROWS`` unrelated vectors a
bucket), tables follow the bits, so that a pair at the threshold is found with
probability ``recall`` at every size.

Vectors that are null, zero, or hold null or non-finite components link with
nothing; vectors of different lengths do not link.  Exact copies are one vector
with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .graph import Forest, components, split_groups
from .pairs import bounds, fixed, group_ids, whole_groups

#: Unrelated vectors that share a bucket, about.
BUCKET_ROWS = 64
#: Rows of a bucket that are compared in one unit.
UNIT_ROWS = 1_024
#: Share of the pairs at the threshold that some table brings together.
RECALL = 0.99


def tables_for(vectors: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = max(4, min(28, math.ceil(math.log2(max(vectors, 2) / BUCKET_ROWS)) if vectors > BUCKET_ROWS else 4))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _blob(vectors: DataFrame, column: str, kind: type) -> DataFrame:
    """Add ``vec``: the numbers of a valid vector as they are stored, else null."""

    @F.pandas_udf(T.BinaryType())
    def of(col: pd.Series) -> pd.Series:
        out: list[bytes | None] = []
        for x in col:
            v = None if x is None else np.asarray(x, np.float64)  # null components become nan
            out.append(v.astype(kind).tobytes() if v is not None and v.ndim == 1 and len(v) and np.isfinite(v).all() and v.any() else None)
        return pd.Series(out, dtype=object)

    return vectors.withColumn("vec", of(F.col(column)))


def _compare(part: pa.Table, threshold: float, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked rows (i, j) of each unit, each pair in its first table only, and
    all pairs' weights are left to the caller."""
    ids = group_ids(part, ["t", "k", "dim", "p", "q"])
    t, mine = part["t"].to_numpy(), part["mine"].to_numpy()
    cross = part["p"].to_numpy() != part["q"].to_numpy()
    sig = fixed(part, "sig", np.int32)
    first, size = bounds(ids)
    raw = part["vec"].combine_chunks()
    got: list[tuple[np.ndarray, np.ndarray]] = []
    for a, n in zip(first, size, strict=True):
        if n < 2:
            continue
        v = fixed(pa.table({"vec": raw.slice(a, n)}), "vec", kind).astype(np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow of squares
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        for lo in range(0, n, 512):
            i, j = np.nonzero(v[lo : lo + 512] @ v.T >= threshold)
            i = i + lo
            up = i < j
            i, j = i[up] + a, j[up] + a
            if cross[a]:
                other = mine[i] != mine[j]
                i, j = i[other], j[other]
            if t[a] and len(i):
                fresh = ~(sig[i, : t[a]] == sig[j, : t[a]]).any(axis=1)
                i, j = i[fresh], j[fresh]
            if len(i):
                got.append((i, j))
    if not got:
        return np.empty(0, int), np.empty(0, int), ids
    return np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]), ids


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = 0.9, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of ``vectors``.

    ``n_links`` counts the other rows that a row is linked with directly,
    ``component_id`` is the smallest key that links reach, the row's own
    included, and ``kept`` marks the row that stands for its component.
    """
    # Floats are moved as floats and compared as doubles.
    kind = np.float32 if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else np.float64
    width = np.dtype(kind).itemsize
    rows = cut(_blob(vectors.select(F.col(key).cast("long").alias("_key"), F.col(column).alias("_v")), "_v", kind).select("_key", "vec", F.unhex(F.sha2("vec", 256)).alias("same")))
    distinct = rows.filter("vec IS NOT NULL AND _key IS NOT NULL").groupBy("same").agg(F.min("_key").alias("rep"), F.count("*").alias("w"), F.first("vec").alias("vec"))
    distinct = cut(distinct)
    bits, tables = tables_for(distinct.count(), threshold, recall)

    @F.pandas_udf(T.BinaryType())
    def sign(vec: pd.Series) -> pd.Series:
        planes: dict[int, np.ndarray] = {}
        out = np.empty(len(vec), object)
        dims = vec.map(len).to_numpy() // width
        weight = (1 << np.arange(bits)).astype(np.int64)
        for d in np.unique(dims):
            if d not in planes:
                planes[d] = np.random.default_rng((seed, int(d))).standard_normal((int(d), bits * tables))
            at = np.flatnonzero(dims == d)
            for lo in range(0, len(at), 2048):
                some = at[lo : lo + 2048]
                v = np.frombuffer(b"".join(vec.iloc[some]), kind).reshape(len(some), -1).astype(np.float64)
                v = v / np.abs(v).max(axis=1, keepdims=True)
                keys = ((v @ planes[d] >= 0).reshape(len(some), tables, bits) @ weight).astype(np.int32)
                out[some] = [r.tobytes() for r in keys]
        return pd.Series(out)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def keys_of(sig: pd.Series) -> pd.Series:
        return sig.map(lambda b: np.frombuffer(b, np.int32))

    signed = cut(distinct.select("rep", "w", "vec", sign("vec").alias("sig")))
    dealt = signed.select("rep", "w", "vec", "sig", (F.octet_length("vec") / width).cast("int").alias("dim"), F.posexplode(keys_of("sig")).alias("t", "k"))
    units = split_groups(dealt, ["t", "k", "dim"], UNIT_ROWS, "rep")
    unit = ["t", "k", "dim", "p", "q"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, unit, 8_000):
            i, j, _ = _compare(part, threshold, kind)
            if not len(i):
                continue
            rep, at = np.unique(part["rep"].to_numpy(), return_inverse=True)
            w = part["w"].to_numpy()
            n = np.bincount(at[i], w[j], len(rep)) + np.bincount(at[j], w[i], len(rep))
            forest = Forest(len(rep))
            forest.join(at[i], at[j])
            linked = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[forest.roots()[linked]]), pa.array(n[linked].astype(np.int64))], names=["a", "b", "n"])

    spread = units.repartition(*unit).sortWithinPartitions(*unit)
    found = cut(spread.select(*unit, "mine", "rep", "w", "vec", "sig").mapInArrow(compare, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    classes = distinct.select("same", "rep", "w").join(counts, "rep", "left").join(components(found.select("a", "b")), F.col("rep") == F.col("node"), "left")
    classes = cut(classes.select("same", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    joined = rows.select("_key", "same").join(classes, "same", "left")
    own = F.col("_key").isNotNull()
    component = F.when(own, F.coalesce("component_id", "_key"))
    return joined.select(F.col("_key").alias(key), F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("_key"), F.lit(False)).alias("kept"))
