"""Centroid clustering in exact integers, with block-norm screening.

Components become the integers floor(256 x).  A vector is compressed to the sum
and the residual norm of each of its ``BLOCKS`` segments, once; centroids are
compressed the same way in each round.  By Cauchy-Schwarz, the squared distance
of a vector x and a centroid c is at least

    sum over segments of (sum x - sum c)^2 / width + (|residual x| - |residual c|)^2

so that centroids whose bound lies above the distance of the one with the least
bound are discarded; only the others get exact distances in integers.  Bounds
are lowered by more than their rounding errors: nothing that could be nearest,
or tie, is lost.

Vectors live in a table of the shared folder, which every round reads.  A round
adds up counts and components of each cluster in tasks, then over tasks key by
key; only the sums of the clusters come to the driver.

Vectors that are null, of another length, or hold null or non-finite components
are left out.  Repeated rows count as often as they occur; a null id is kept and
comes last for a start; ties go to the smaller number.  Fewer vectors than
centroids give as many centroids as vectors; an empty table gives no rows.
Components beyond 2^27 are computed with unbounded integers, and what does not
fit into a long is null.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Segments of a vector, and vectors that are compared at a time.
BLOCKS, ROWS_AT_ONCE = 16, 4_096
#: Components up to this are handled as 64-bit integers without overflow.
SMALL = 1 << 27
_LONG = 1 << 63
#: Integers are stored so that their bytes sort as they do.
_STORED, _ZERO = np.dtype(">u4"), 1 << 31


def compress(x: np.ndarray) -> np.ndarray:
    """Scaled sums, then residual norms, of the segments of each row."""
    parts = x.reshape(len(x), BLOCKS, -1)
    width, sums = parts.shape[2], parts.sum(axis=2)
    spread = np.sqrt((width * (parts * parts).sum(axis=2) - sums * sums) / width)  # integers up to the root: no cancellation
    return np.hstack((sums / np.sqrt(width), spread))


def nearest(x: np.ndarray, small: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each row of ``x``, the squared
    distance, and how many exact distances that took.  ``small``: the rows of
    ``x``, compressed."""
    other = compress(centroids)
    squares = (small * small).sum(axis=1)[:, None] + (other * other).sum(axis=1)
    bound = squares - 2 * (small @ other.T) - 1e-9 * squares - 1.0
    best = np.argmin(bound, axis=1)
    at = np.arange(len(x))
    distance = ((x - centroids[best]) ** 2).sum(axis=1)
    left = bound <= distance[:, None]
    left[at, best] = False
    n = len(x)
    for k in np.flatnonzero(left.any(axis=0)):
        rows = np.flatnonzero(left[:, k] & (bound[:, k] <= distance))
        if not len(rows):
            continue
        n += len(rows)
        d = ((x[rows] - centroids[k]) ** 2).sum(axis=1)
        closer = (d < distance[rows]) | ((d == distance[rows]) & (k < best[rows]))
        best[rows[closer]], distance[rows[closer]] = k, d[closer]
    return best, distance, n


def nearest_wide(x: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    """The same for one vector, in unbounded integers."""
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))[::-1]


def _stored(vectors: DataFrame, key: str, column: str, length: int) -> DataFrame:
    """(key, x, small, wide): integers of the vectors that are kept, compressed;
    ``wide`` holds those with large components."""
    ok = F.col("v").isNotNull() & (F.size("v") == length) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v")).filter(F.coalesce(ok, F.lit(False)))

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b["v"].flatten()).reshape(b.num_rows, length)
            with np.errstate(over="ignore"):
                scaled = np.floor(v * 256.0)
            large = (np.abs(scaled) > SMALL).any(axis=1)
            x = np.where(large[:, None], 0, scaled).astype(np.int64)
            small = compress(x)
            wide = [pickle.dumps([exact_floor(c) for c in row]) if big else None for row, big in zip(v.tolist(), large.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["key"], pa.array([r.tobytes() for r in (x + _ZERO).astype(_STORED)]), pa.array([r.tobytes() for r in small]), pa.array(wide, pa.binary())], names=["key", "x", "small", "wide"])

    return kept.mapInArrow(integers, "key long, x binary, small binary, wide binary")


def decoded(raw: bytes) -> np.ndarray:
    """The integers of stored bytes."""
    return np.frombuffer(raw, _STORED).astype(np.int64) - _ZERO


def exact_floor(x: float) -> int:
    """floor(256 x) of any finite double."""
    top, bottom = x.as_integer_ratio()
    return 256 * top // bottom


class Assigner:
    """Nearest centroids of batches of stored vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        self.fits = all(abs(c) <= SMALL for row in centroids for c in row)
        self.centroids = np.array(centroids, np.int64) if self.fits else None

    def __call__(self, b: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray | list[list[int]], list[int] | np.ndarray]]:
        """(rows, clusters, vectors, distances) of parts of a batch."""
        wide = np.array([w is not None for w in b["wide"].to_pylist()]) if b["wide"].null_count < b.num_rows else np.zeros(b.num_rows, bool)
        for lo in range(0, b.num_rows, ROWS_AT_ONCE):
            part = b.slice(lo, ROWS_AT_ONCE)
            rows = slice(lo, lo + part.num_rows)
            x = decoded(b"".join(part["x"].to_pylist())).reshape(part.num_rows, -1)
            if self.fits and not wide[rows].any():
                small = np.frombuffer(b"".join(part["small"].to_pylist())).reshape(part.num_rows, -1)
                best, distance, _ = nearest(x, small, self.centroids)
                yield rows, best, x, distance
                continue
            each = [pickle.loads(w) if w is not None else r for w, r in zip(part["wide"].to_pylist(), x.tolist(), strict=True)]
            found = [nearest_wide(r, self.exact) for r in each]
            yield rows, np.array([k for k, _ in found]), each, [d for _, d in found]


def sums(stored: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of components of each non-empty cluster."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, total = Assigner(centroids), {}
        for b in batches:
            for _, best, x, _ in assign(b):
                for k in np.unique(best).tolist():
                    mine = np.flatnonzero(best == k)
                    add = x[mine].sum(axis=0).tolist() if isinstance(x, np.ndarray) else [sum(c) for c in zip(*(x[i] for i in mine), strict=True)]
                    n, s = total.get(k, (0, [0] * len(add)))
                    total[k] = (n + len(mine), [p + q for p, q in zip(s, add, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pickle.dumps(v) for v in total.values()], pa.binary())], names=["k", "s"])

    found = stored.select("x", "small", "wide").mapInArrow(of, "k int, s binary").rdd.map(lambda r: (r["k"], pickle.loads(r["s"])))
    merged = found.reduceByKey(lambda a, b: (a[0] + b[0], [p + q for p, q in zip(a[1], b[1], strict=True)]))
    return dict(merged.collect())  # a row for each centroid


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", centroids: int = 40, rounds: int = 5, length: int = 64, seed: int = 2) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of
    each vector that is kept.

    It starts from the vectors with the smallest sha256 of ``<seed>:<key>``; of
    rows with one key, the smaller components come first.
    """
    if length % BLOCKS or length // BLOCKS > 16:
        raise ValueError(f"length must be a multiple of {BLOCKS}, at most {16 * BLOCKS}")
    spark = vectors.sparkSession
    stored = cut(_stored(vectors, key, column, length))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = stored.select(order.alias("h"), "x", "wide").orderBy(F.asc_nulls_last("h"), "x", "wide").limit(centroids).collect()  # a row for each centroid
    now = [pickle.loads(r["wide"]) if r["wide"] is not None else decoded(r["x"]).tolist() for r in first]
    for _ in range(rounds):
        for k, (n, s) in sums(stored, now).items() if now else ():
            now[k] = [c // n for c in s]
    final = list(now)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(final)
        for b in batches:
            for rows, best, _, distance in assign(b):
                d = pa.array([int(x) if x < _LONG else None for x in distance], pa.int64())
                yield pa.RecordBatch.from_arrays([b["key"].slice(rows.start, len(best)), pa.array(best, pa.int32()), d], names=["key", "cluster", "distance"])

    found = cut(stored.mapInArrow(assigned, "key long, cluster int, distance long"))
    wide = T.DecimalType(38, 0)
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast(wide)).alias("d"), F.count("distance").alias("n"), F.count("*").alias("all")).collect()  # a row for each centroid
    fits = lambda total, whole: int(total) if whole and total < _LONG else None
    whole = all(r["n"] == r["all"] for r in by_cluster)
    total = fits(sum(int(r["d"] or 0) for r in by_cluster), whole)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    table = [(r["cluster"], fits(r["d"] or 0, r["n"] == r["all"]), total, digests[r["cluster"]]) for r in by_cluster]
    about = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(about), "cluster")  # a row for each centroid
    return joined.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
