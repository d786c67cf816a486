"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Statistics of a whole text (byte classes, words, repetition) are standardized
and mapped to random Fourier features, which approximate a Gaussian kernel.
Normal equations are summed by partition and solved for ridge scores; isotonic
regression on held-apart labelled rows turns scores into probabilities.

The classifier is fitted on a bounded sample of labelled rows
(``MAX_LABELLED``); scoring covers every row.  Null and empty texts have the
statistics of an empty text and are scored like any other.  Texts of any length
count whole; repeated rows and equal texts have equal scores; an empty table
stays empty, and a model fitted on nothing scores all texts alike.  Of several
texts with one labelled key the first in order of text is learned from.  A
column of the output's name is replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, only

#: Labelled texts that the classifier is fitted on, at most (smallest hashes).
MAX_LABELLED = 16_000
#: Random Fourier features, width of the kernel, ridge penalty.
FEATURES, WIDTH, PENALTY = 320, 4.0, 1e-3
#: Characters of text whose statistics are taken at a time.
SLICE_CHARS = 2 << 20

# Classes of bytes: 0 space, 1 line end, 2 a-z, 3 A-Z, 4 digit, 5 punctuation
# of sentences, 6 other ASCII, 7 beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[128:] = 7
for _k, _chars in enumerate([b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:'\"()-?"]):
    _CLASS[list(_chars)] = _k
N_STATISTICS = 23


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of statistics for each text."""
    out = np.zeros((len(texts), N_STATISTICS))
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t or "") > SLICE_CHARS:
            out[lo:i] = _statistics(texts[lo:i])
            lo, held = i, 0
        held += len(t or "")
    if lo < len(texts):
        out[lo:] = _statistics(texts[lo:])
    return out


def _statistics(texts: list[str | None]) -> np.ndarray:
    raw = [(t or "").encode() for t in texts]
    n = len(raw)
    size = np.fromiter(map(len, raw), np.int64, n)
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    first = np.cumsum(size + 1) - size - 1
    kind = _CLASS[data]
    share = np.stack([np.add.reduceat((kind == k).astype(np.int64), first) for k in range(8)], axis=1).astype(float)
    share[:, 0] -= 1  # the joining space
    some = np.maximum(size, 1)[:, None]
    share /= some
    white = kind <= 1
    start = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    end = np.flatnonzero(white & np.concatenate(([False], ~white[:-1])))
    owner = np.searchsorted(first, start, side="right") - 1
    words = np.bincount(owner, minlength=n)
    at_least = np.maximum(words, 1)
    mean = lambda x: np.bincount(owner, x, n) / at_least
    length = (end - start).astype(float)
    last, lead = kind[end - 1], kind[start]
    long = mean(length)
    out = np.zeros((n, N_STATISTICS))
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    out[:, 2:10] = np.sqrt(np.maximum(share, 0))
    out[:, 10] = long
    out[:, 11] = np.sqrt(np.maximum(mean(length * length) - long * long, 0))
    out[:, 12] = mean(last == 6)
    out[:, 13] = mean((last == 6) & (length == 1))
    out[:, 14] = mean(lead == 3)
    second = np.where(length > 1, kind[np.minimum(start + 1, len(kind) - 1)], 0)
    out[:, 15] = mean((lead == 3) & (second == 3))
    out[:, 16] = mean(length <= 3)
    out[:, 17] = mean(length > 14)
    for i, t in enumerate(texts):
        if not t:
            continue
        w = t.split()
        k = len(w)
        if k:
            h = np.fromiter(map(hash, w), np.int64, k)
            out[i, 18] = len(set(w)) / k
            if k > 1:
                out[i, 19] = np.count_nonzero(h[1:] == h[:-1]) / (k - 1)
            if k > 3:
                with np.errstate(over="ignore"):
                    triple = h[2:] * np.int64(31) + h[1:-1] * np.int64(1_000_003) + h[:-2]
                triple.sort()
                out[i, 20] = np.count_nonzero(triple[1:] == triple[:-1]) / (k - 2)
        lines = t.split("\n")
        out[i, 21] = 1 - len(set(lines)) / len(lines)
        out[i, 22] = np.log1p(len(t) / len(lines))
    return out


@dataclass
class Model:
    """Standardization, random directions, ridge weights, calibration."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.hstack((np.cos(z) * np.sqrt(2 / self.directions.shape[1]), np.ones((len(x), 1))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Ridge scores."""
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, 0 to 1."""
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing least-squares fit of y to x."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    blocks: list[list[float]] = []  # weight, mean of y, least x, largest x
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        blocks.append([1.0, b, a, a])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, v, _, top = blocks.pop()
            last = blocks[-1]
            last[1] = (last[0] * last[1] + w * v) / (last[0] + w)
            last[0] += w
            last[3] = top
    knots, values = [], []
    for _, v, low, top in blocks:
        knots.append(low)
        values.append(v)
        if top > low:
            knots.append(top)
            values.append(v)
    return np.array(knots), np.array(values)


def _with_statistics(docs: DataFrame, text: Column, out: str) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(statistics(batch.tolist())), dtype=object)

    return docs.withColumn(out, of(text))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", calibrate: Column | None = None, seed: int = 5) -> Model:
    """Fit on labelled texts.

    ``labels`` has (key, label); several labels of one key are averaged and
    rounded, null ones left out.  ``calibrate`` is a condition on ``key`` that
    sets the rows apart that calibrate scores; by default a fifth of them.
    """
    if calibrate is None:
        calibrate = F.pmod(F.xxhash64(key, F.lit("calibrate")), F.lit(5)) == 0
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64(key, F.lit("sample")), key).limit(MAX_LABELLED)  # 16 bytes a row: bounded, so it may be broadcast
    rows = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(known), key)
    rows = rows.groupBy(key).agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"))  # a repeated key counts once
    rows = cut(_with_statistics(rows.withColumn("_apart", calibrate), F.col("_text"), "x").select("x", F.col("_y").alias("y"), F.col("_apart").alias("apart")).repartition(8))
    d = N_STATISTICS

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * d + 1)
        for b in batches:
            x = np.array(b["x"].to_pylist(), float).reshape(-1, d)
            total += np.concatenate((x.sum(axis=0), (x * x).sum(axis=0), [len(x)]))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["s"])

    s = sum((np.array(r["s"]) for r in rows.select("x").mapInArrow(moments, "s array<double>").collect()), np.zeros(2 * d + 1))
    n = max(s[-1], 1)
    mean = s[:d] / n
    scale = np.sqrt(np.maximum(s[d : 2 * d] / n - mean * mean, 0))
    scale[scale < 1e-6] = 1.0
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.standard_normal((d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    m = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((m, m)), np.zeros(m)
        for b in batches:
            z = model.features(np.array(b["x"].to_pylist(), float).reshape(-1, d))
            gram += z.T @ z
            right += z.T @ b["y"].to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], names=["g", "r"])

    sums = rows.filter("NOT apart").select("x", "y").mapInArrow(equations, "g binary, r binary").collect()  # one row for each of 8 partitions
    gram = sum((np.frombuffer(r["g"]).reshape(m, m) for r in sums), np.zeros((m, m)))
    right = sum((np.frombuffer(r["r"]) for r in sums), np.zeros(m))
    model.weights = np.linalg.solve(gram + PENALTY * np.eye(m), right)
    apart = rows.filter("apart").select("x", "y").collect()  # a fifth of MAX_LABELLED at most
    if len(apart) >= 20:
        model.knots, model.values = isotonic(model.raw(np.array([r["x"] for r in apart])), np.array([float(r["y"]) for r in apart]))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the calibrated score (0 to 1) of each text; a column of that name
    is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kilobytes whatever the data

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only("quality", lambda: None)
        for batch in batches:
            yield pd.Series(sent.value.score(statistics(batch.tolist())))

    return docs.withColumn(out, of(F.col(text)))
