"""Toxicity: bags of subword embeddings, averaged into a linear softmax.

A word is the bag of itself and its character n-grams, with its ends marked; its
vector is the mean of their embeddings, and a text's vector the mean of its
words'.  A softmax over that is trained jointly with the embeddings, so that a
misspelling or an unseen form of a word shares the vectors of its n-grams.

Passages of a clean text are clean: some of each are learned from as texts of
their own, so that no common word tips a short text.  A fifth of the labelled
texts is held apart and sets the temperature and the offset of the softmax.

The classifier is fitted on a bounded sample of labelled rows
(``MAX_LABELLED``); scoring covers every row and whole texts.  Null and empty
texts, and texts of punctuation only, have the zero vector and the score that
belongs to it.  Repeated rows and equal texts score alike; an empty table stays empty,
and a model fitted on nothing scores all texts 0.  Of several texts with one
labelled key the first in order of text is learned from.  A column of the
output's name is replaced, others are kept.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, only

#: Labelled texts that the classifier is fitted on, at most (smallest hashes).
MAX_LABELLED = 6_000
#: Buckets of subwords; lengths of n-grams; texts that must hold a bucket.
BUCKETS, SHORTEST, LONGEST, MIN_TEXTS = 1 << 20, 3, 6, 5
#: Numbers of a vector; texts and size of a step; steps of the training, about,
#: and passes over the sample, at least and at most.
WIDTH, BATCH, STEP, STEPS, PASSES = 4, 64, 1.0, 3_600, (3, 20)
#: Passages that are taken from each clean text, and their words.
PASSAGES, PASSAGE_WORDS = 12, 6
#: Words that a worker remembers between batches; characters taken at a time.
CACHE_WORDS, SLICE_CHARS = 500_000, 1 << 20
#: Characters that are no part of a word at its ends.
_EDGES = ".,;:!?\"'()[]{}<>|#$%&*-_/\\"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> Iterator[list[str]]:
    """The words of a text, lower-cased, a bounded number of characters at a
    time; no word is cut."""
    rest = text or ""
    at = 0
    while at < len(rest):
        end = at + SLICE_CHARS
        while end < len(rest) and not rest[end].isspace():
            end += 1
        yield [w for chunk in rest[at:end].lower().split() if (w := chunk.strip(_EDGES))]
        at = end


def subwords(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every subword of some words, ordered by word:
    n-grams with marked ends, and each word as a whole."""
    marked = "".join(f"<{w}>" for w in found)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.fromiter((len(w) + 2 for w in found), np.int64, len(found))
    owner = np.repeat(np.arange(len(found)), size)
    end = np.cumsum(size)[owner]
    owners = [np.arange(len(found))]
    buckets = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in found), np.int64, len(found))]
    hashed = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        hashed = hashed[:m] * _BASE + codes[n - 1 :]  # wraps: a hash
        if n >= SHORTEST:
            inside = np.flatnonzero(np.arange(n, m + n) <= end[:m])
            mixed = (hashed[inside] + np.uint64(n)) * _MIX
            owners.append(owner[inside])
            buckets.append(((mixed ^ (mixed >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64))
    whose, which = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(whose, kind="stable")
    return whose[order], which[order]


def _slices(found: list[str]) -> Iterator[list[str]]:
    """Words in lists of a bounded number of characters."""
    lo, held = 0, 0
    for i, w in enumerate(found):
        if i > lo and held + len(w) > SLICE_CHARS:
            yield found[lo:i]
            lo, held = i, 0
        held += len(w) + 2
    if lo < len(found):
        yield found[lo:]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text, ascending, and their weights in its mean."""
    counts: Counter[str] = Counter()
    for some in words(text):
        counts.update(some)
    total = sum(counts.values())
    ids, weights = [np.empty(0, np.int64)], [np.empty(0)]
    for some in _slices(list(counts)):
        whose, which = subwords(some)
        share = np.fromiter((counts[w] for w in some), float, len(some)) / np.bincount(whose) / total
        got, at = np.unique(which, return_inverse=True)
        ids.append(got)
        weights.append(np.bincount(at, share[whose]))
    got, at = np.unique(np.concatenate(ids), return_inverse=True)
    return got.astype(np.int32), np.bincount(at, np.concatenate(weights), len(got)).astype(np.float32)


def passages(text: str | None, seed: int) -> list[str]:
    """Some passages of a text, if it is longer than two of them."""
    w = (text or "").split()
    if len(w) <= 2 * PASSAGE_WORDS:
        return []
    return [" ".join(w[a : a + PASSAGE_WORDS]) for a in np.random.default_rng(seed).integers(0, len(w) - PASSAGE_WORDS, PASSAGES)]


@dataclass
class Model:
    """Buckets in use, their embeddings, and the softmax over two classes."""

    buckets: np.ndarray
    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """What each bucket adds to the odds of toxicity."""
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])
        return out


Bag = tuple[np.ndarray, np.ndarray]


def train(bags: list[Bag], labels: np.ndarray, seed: int = 7) -> Model:
    """Embeddings and softmax, fitted jointly by adaptive gradient steps.
    ``bags`` is used up."""
    seen = np.zeros(BUCKETS, np.int32)
    for ids, _ in bags:
        seen[ids] += 1
    kept = np.flatnonzero(seen >= MIN_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    for i, (ids, weight) in enumerate(bags):
        known = place[ids] >= 0
        bags[i] = (place[ids[known]], weight[known])
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((len(kept), WIDTH)) * 0.1).astype(np.float32)
    softmax = (rng.standard_normal((WIDTH, 2)) * 0.1).astype(np.float32)
    bias = np.log(np.array([((labels == k).sum() + 0.5) / (len(labels) + 1) for k in (0, 1)])).astype(np.float32)
    past, past_softmax = np.full(len(kept), 1e-8, np.float32), 1e-8
    for _ in range(min(PASSES[1], max(PASSES[0], -(-STEPS * BATCH // max(len(bags), 1))))):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            owner = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
            ids, weight = (np.concatenate([bags[i][k] for i in some]) for k in (0, 1))
            got, at = np.unique(ids, return_inverse=True)
            parts = vectors[ids] * weight[:, None]
            texts = np.stack([np.bincount(owner, parts[:, k], len(some)) for k in range(WIDTH)], axis=1)
            odds = texts @ softmax + bias
            p = np.exp(odds - odds.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1  # now the gradient of the odds
            back = (p @ softmax.T)[owner] * weight[:, None]
            step = np.stack([np.bincount(at, back[:, k], len(got)) for k in range(WIDTH)], axis=1)
            past[got] += (step * step).mean(axis=1)
            vectors[got] -= (STEP * step / np.sqrt(past[got])[:, None]).astype(np.float32)
            turn = texts.T @ p
            past_softmax += (turn * turn).mean()
            softmax -= (STEP / 5 * turn / np.sqrt(past_softmax)).astype(np.float32)
            bias -= (STEP / 20 * p.mean(axis=0)).astype(np.float32)
    return Model(kept.astype(np.int32), vectors, softmax, bias)


def calibrated(model: Model, bags: list[Bag], labels: np.ndarray) -> Model:
    """The model with the temperature and offset that fit texts held apart
    best; as it is if these are few or of one class."""
    if len(labels) < 50 or labels.min() == labels.max():
        return model
    margins, offset = model.margins(), float(model.bias[1] - model.bias[0])
    odds = np.array([offset + float(margins[ids] @ weight) for ids, weight in bags])
    scale = max(float(np.abs(odds).mean()), 1e-9)
    x = np.stack((np.clip(odds / scale, -6, 6), np.ones(len(odds))), axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps of a logistic fit with a weak prior
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (p - labels) + 1e-2 * w
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), grad)
    if not np.isfinite(w).all() or w[0] <= 0:
        return model
    factor = w[0] / scale
    return Model(model.buckets, model.vectors, (model.softmax * factor).astype(np.float32), np.array([0.0, offset * factor + w[1]], np.float32))


def fit_texts(texts: list[str | None], labels: list[int]) -> Model:
    """A model of labelled texts; each fifth one calibrates."""
    y = np.array(labels, np.int64)
    bags, known, apart, apart_y = [], [], [], []
    for i, text in enumerate(texts):
        if i % 5 == 4:
            apart.append(bag(text))
            apart_y.append(y[i])
            continue
        bags.append(bag(text))
        known.append(y[i])
        if not y[i]:
            parts = passages(text, i)
            bags += [bag(p) for p in parts]
            known += [0] * len(parts)
    return calibrated(train(bags, np.array(known, np.int64)), apart, np.array(apart_y, np.int64))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on labelled texts, in one task over the bounded sample.

    ``labels`` has (key, label); several labels of one key are averaged and
    rounded, null ones left out.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64(key, F.lit("toxicity")), key).limit(MAX_LABELLED)  # 16 bytes a row: bounded, so it may be broadcast
    rows = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(known), key)
    rows = cut(rows.groupBy(key).agg(F.min("_text").alias("text"), F.first("_y").alias("y")))  # a repeated key counts once

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for b in batches:
            texts += b["text"].to_pylist()
            y += b["y"].to_pylist()
        m = fit_texts(texts, y)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (m.buckets, m.vectors, m.softmax, m.bias)], names=["buckets", "vectors", "softmax", "bias"])

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64(key, F.lit("order")), key).select("text", "y")
    got = one.mapInArrow(learn, "buckets binary, vectors binary, softmax binary, bias binary").first()  # BUCKETS rows of WIDTH floats at most
    if got is None:
        return Model(np.empty(0, np.int32), np.empty((0, WIDTH), np.float32), np.zeros((WIDTH, 2), np.float32), np.array([0.0, -np.inf], np.float32))
    floats = {k: np.frombuffer(got[k], np.float32) for k in ("vectors", "softmax", "bias")}
    return Model(np.frombuffer(got["buckets"], np.int32), floats["vectors"].reshape(-1, WIDTH), floats["softmax"].reshape(WIDTH, 2), floats["bias"])


class Scorer:
    """Scores batches of texts; a word's margin is worked out once."""

    def __init__(self, model: Model):
        self.margins, self.offset = model.margins(), float(model.bias[1] - model.bias[0])
        self.known: dict[str, float] = {}

    def score(self, text: str | None) -> float:
        """Probability of toxicity of a whole text."""
        total, n = 0.0, 0
        for some in words(text):
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            new = [w for w in dict.fromkeys(some) if w not in self.known]
            for part in _slices(new):
                whose, which = subwords(part)
                self.known.update(zip(part, (np.bincount(whose, self.margins[which]) / np.bincount(whose)).tolist(), strict=True))
            total += sum(map(self.known.__getitem__, some))
            n += len(some)
        odds = self.offset + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(odds, -700, 700)))) if odds > -np.inf else 0.0


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score (0 to 1) of each text; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of WIDTH floats at most
    tag = uuid.uuid4().hex

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = only(("toxicity", tag), lambda: Scorer(sent.value))
        for batch in batches:
            yield pd.Series([scorer.score(t) for t in batch.tolist()], dtype=float)

    return docs.withColumn(out, of(F.col(text)))
