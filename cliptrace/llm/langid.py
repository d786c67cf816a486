"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language.  An unseen word
falls back to its character n-grams, from the longest length of which any is
known down to single characters.

The model is fitted on a bounded sample: ``per_language`` texts of each
language, chosen by a hash of their key (`fit`).

A null text, one without letters, and every text under a model without languages
are ``und`` with score 0.  Long texts are scored whole, repeated rows alike; of
equally likely languages the first by name wins; an empty table stays empty.
Columns with the names of the output are replaced, others are kept.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, only

#: Languages of a model, at most; more are an error.
MAX_LANGUAGES = 256
#: Chunks that a worker remembers between batches.
CACHE_ENTRIES = 300_000
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Languages, their log prior, and rows of log frequencies by language."""

    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: list[dict[str, int]]  # longest first
    rows: np.ndarray

    def parts(self, word: str) -> list[int]:
        """The rows whose mean scores a word: its own, or by backoff those of
        its longest known n-grams; none if nothing is known."""
        if (row := self.words.get(word)) is not None:
            return [row]
        longest = len(self.grams)
        for k, table in enumerate(self.grams):
            if found := [r for g in grams(word, longest - k) if (r := table.get(g)) is not None]:
                return found
        return []


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 4_000, most_words: int = 120_000, most_grams: int = 60_000, longest: int = 5) -> Model:
    """Fit on at most about ``per_language`` texts of each language.

    Rows with a null text or language are left out.  The size of the model is
    bounded: each language brings its most frequent words, the same number of
    each and about ``most_words`` in all; of these the ``most_grams`` most
    frequent n-grams enter.  Rarer words are scored by their n-grams.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL AND key IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros(0), {}, [{} for _ in range(longest)], np.zeros((0, 0)))
    names = sorted(sizes)
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("lang") == name, min(1.0, per_language / sizes[name])).otherwise(share)
    draw = F.pmod(F.xxhash64("key", F.lit("langid")), F.lit(1_000_000)) / 1e6
    words = rows.filter(draw < share).select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("w <> ''")
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))  # Spark keeps the first rows while it ranks them
    counted = counts.withColumn("place", place).filter(F.col("place") <= max(1, most_words // len(names))).orderBy(F.desc("n"), "w", "lang").collect()
    return _model(names, {n: sizes[n] for n in names}, [(r["lang"], r["w"], r["n"]) for r in counted], most_grams, longest)


def _model(names: list[str], sizes: dict[str, int], counted: list[tuple[str, str, int]], most_grams: int, longest: int) -> Model:
    at = {n: i for i, n in enumerate(names)}
    by_word: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(names)))
    for name, w, n in counted:
        by_word[w][at[name]] += n
    tables: list[dict[str, np.ndarray]] = [dict(by_word)]
    # Frequent words do not drown the rest: n-grams are weighed by a root.
    weighed = [(w, [(i, math.sqrt(c)) for i, c in enumerate(counts.tolist()) if c]) for w, counts in by_word.items()]
    for n in range(longest, 0, -1):
        by_gram: list[dict[str, float]] = [defaultdict(float) for _ in names]
        for w, at_least in weighed:
            found = grams(w, n)
            for i, c in at_least:
                table = by_gram[i]
                for g in found:
                    table[g] += c
        total: dict[str, float] = defaultdict(float)
        for table in by_gram:
            for g, c in table.items():
                total[g] += c
        keep = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[: most_grams // longest]]
        tables.append({g: np.array([table.get(g, 0.0) for table in by_gram]) for g in keep})
    rows, index = [], []
    for table in tables:
        place = {}
        if table:
            m = np.array(list(table.values())) + 0.1
            logs = np.log(m / m.sum(axis=0))
            logs -= logs.mean(axis=1, keepdims=True)  # only differences between languages count
            base = sum(map(len, rows))
            place = {w: base + i for i, w in enumerate(table)}
            rows.append(logs)
        index.append(place)
    prior = np.log(np.array([sizes[n] for n in names], float) / sum(sizes.values()))
    return Model(names, prior, index[0], index[1:], np.concatenate(rows) if rows else np.zeros((0, len(names))))


class _Chunks(dict):
    """White-space separated chunk -> place; new chunks are noted with the
    rows that score them, and scored together by ``settle``."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((1, len(model.languages)))  # place 0: no letters
        self.words = np.zeros(1, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.new_rows, self.new_weights, self.new_counts, self.new_words = [], [], [], []

    def __missing__(self, chunk: str) -> int:
        found = [w for w in _LETTERS.findall(chunk.lower()) if any(map(str.isalpha, w))]
        if not found:
            self[chunk] = 0
            return 0
        self[chunk] = n = len(self.rows) + len(self.new_counts)
        count = 0
        for w in found:
            if rows := self.model.parts(w):
                self.new_rows += rows
                self.new_weights += [1 / len(rows)] * len(rows)
                count += len(rows)
        self.new_counts.append(count)
        self.new_words.append(len(found))
        return n

    def settle(self) -> None:
        """Score what is new."""
        if not self.new_counts:
            return
        owner = np.repeat(np.arange(len(self.new_counts)), self.new_counts)
        each = self.model.rows[np.array(self.new_rows, np.int64)] * np.array(self.new_weights)[:, None]
        new = np.zeros((len(self.new_counts), self.rows.shape[1]))
        for k in range(new.shape[1]):
            new[:, k] = np.bincount(owner, each[:, k], len(new))
        self.rows = np.concatenate((self.rows, new))
        self.words = np.concatenate((self.words, np.array(self.new_words, np.int64)))
        self._clear()


class Scorer:
    """Scores batches of texts."""

    def __init__(self, model: Model):
        self.model, self.chunks = model, _Chunks(model)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks = _Chunks(self.model)
        get = self.chunks.__getitem__
        each = [np.fromiter(map(get, t.split()), np.int32) if t else np.empty(0, np.int32) for t in texts]
        self.chunks.settle()
        rows, words = self.chunks.rows, self.chunks.words
        names, out, scores = self.model.languages, [], np.zeros(len(texts))
        for i, at in enumerate(each):
            n = int(words[at].sum())
            if not n or not names:
                out.append(UNDETERMINED)
                continue
            total = rows[at].sum(axis=0)
            odds = self.model.prior + total * (min(n, 30) / n)
            best = int(np.argmax(self.model.prior / n + total / n))
            p = np.exp(odds - odds.max())
            out.append(names[best])
            scores[i] = p[best] / p.sum()
        return out, scores


def identify(docs: DataFrame, model: Model, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its posterior (0 to 1).

    ``und`` with score 0: a null text, one without letters, or a model without
    languages.  Columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the limits of fit()
    tag = uuid.uuid4().hex
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = only(("langid", tag), lambda: Scorer(sent.value))
        for batch in batches:
            texts = batch.tolist()
            names, scores = [], []
            for lo in range(0, len(texts), 2_000):
                a, b = scorer.score(texts[lo : lo + 2_000])
                names += a
                scores.append(b)
            yield pd.DataFrame({"name": pd.Series(names, dtype=object), "score": np.concatenate(scores) if scores else np.zeros(0)})

    found = fresh(docs, "_language")
    judged = docs.withColumn(found, of(F.col(text)))
    return judged.withColumns({name: F.col(found)["name"], score: F.col(found)["score"]}).drop(found)
