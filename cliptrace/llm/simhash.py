"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint is the bitwise majority of its shingles' hashes.  Each
distinct fingerprint gets its Hamming distances to many reference fingerprints
(pivots) once.  Fingerprints that agree on enough blocks of bits meet in a
group; there a pair is discarded when any pivot coordinate differs by more than
the threshold (the triangle inequality), and what survives is verified bit by
bit.  Links become components.

At most ``k`` differing bits leave ``e`` of ``k + e`` blocks untouched, so that
trying all choices of ``e`` blocks loses no link; ``e`` grows with the number of
fingerprints and only decides how finely they are grouped.

Null and empty texts have the fingerprint zero and are linked like any other.
Rows with a null id get a fingerprint and a null component.  Texts of any length
count whole; rows that repeat an id, and ties, share a component by their
fingerprints; an empty table stays empty.  The result has no other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, only
from .graph import Forest, components, split_groups
from .pairs import bounds, fixed, group_ids, whole_groups

#: Reference fingerprints; a row carries one byte for each.
PIVOTS = 16
#: Rows of a group that are compared in one unit.
UNIT_ROWS = 1_024


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text.

    A-Z are lower-cased; words are runs of other bytes than white space of
    ASCII; shingles are ``width`` words, all of them if there are fewer.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - width + 1
        shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(width)), strict=True))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        part = h[lo : lo + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 4, seed: int = 42) -> DataFrame:
    """Add the fingerprint of each text as a signed long."""

    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only("simhash", lambda: None)  # what other stages left here goes
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, width, seed) for t in batch.tolist()], np.uint64).view(np.int64))

    return docs.withColumn(out, of(F.col(text)))


def as_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def pivots(n: int = PIVOTS, seed: int = 7) -> np.ndarray:
    """Reference fingerprints, the same for a seed."""
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64)


#: Unrelated fingerprints that share a group, at most, before groups get finer.
GROUP_ROWS = 512


def block_choices(rows: int, bits: int = 4) -> list[int]:
    """Masks of the blocks that a group shares, for so many fingerprints."""
    free = 1
    while free < 3 and 64 * free / (bits + free) < np.log2(max(rows, 2) / GROUP_ROWS):
        free += 1
    edges = np.linspace(0, 64, bits + free + 1).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(blocks, free)]


def _near(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one group whose fingerprints differ in up to ``bits`` bits."""
    ids = group_ids(table, ["t", "k", "p", "q"])
    fp, pv = table["fp"].to_numpy().view(np.uint64), fixed(table, "pv", np.uint8).astype(np.int16)
    mine, cross = table["mine"].to_numpy(), table["p"].to_numpy() != table["q"].to_numpy()
    first, size = bounds(ids)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        for c in range(0, pv.shape[1], 4):  # a few coordinates at a time
            keep = (np.abs(pv[i, c : c + 4] - pv[j, c : c + 4]) <= bits).all(axis=1)
            i, j = i[keep], j[keep]
        ok = (np.bitwise_count(fp[i] ^ fp[j]) <= bits) & (~cross[i] | (mine[i] != mine[j]))
        found.append((i[ok], j[ok]))

    small = size <= 64
    todo = np.flatnonzero(np.repeat(small, size))
    for step in range(1, int(size[small].max(initial=1))):
        todo = todo[todo + step < len(ids)]
        todo = todo[ids[todo] == ids[todo + step]]
        if not len(todo):
            break
        verify(todo, todo + step)
    for a, n in zip(first[~small], size[~small], strict=True):
        lead = pv[a : a + n, 0]
        order = np.argsort(lead, kind="stable") + a
        lead = pv[order, 0]
        upto = np.searchsorted(lead, lead + bits, side="right")
        for lo in range(0, n, 256):
            hi = min(lo + 256, n)
            count = upto[lo:hi] - np.arange(lo + 1, hi + 1)
            i = np.repeat(np.arange(lo, hi), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
            verify(order[i], order[j])
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.empty(0, int), np.empty(0, int))


def links(prints: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (a, b) that connect what links of up to ``bits`` bits connect.

    ``prints`` has distinct fingerprints ``fp`` and their representatives
    ``rep``.  Each unit returns a spanning forest, never all its pairs.
    """
    marks = pivots()

    @F.pandas_udf(T.BinaryType())
    def distances(fp: pd.Series) -> pd.Series:
        d = np.bitwise_count(fp.to_numpy().view(np.uint64)[:, None] ^ marks[None, :]).astype(np.uint8)
        return pd.Series([r.tobytes() for r in d], dtype=object)

    table = cut(prints.select("rep", "fp").withColumn("pv", distances("fp")))
    masks = block_choices(table.count(), bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(signed)])).alias("x")
    rows = table.select("rep", "fp", "pv", keys).select("rep", "fp", "pv", "x.t", "x.k")
    units = split_groups(rows, ["t", "k"], UNIT_ROWS, "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["t", "k", "p", "q"]):
            i, j = _near(part, bits)
            if len(i):
                rep, at = np.unique(part["rep"].to_numpy(), return_inverse=True)
                forest = Forest(len(rep))
                forest.join(at[i], at[j])
                root = forest.roots()
                child = np.flatnonzero(root != np.arange(len(rep)))
                yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[root[child]])], names=["a", "b"])

    dealt = units.repartition("t", "k", "p", "q").sortWithinPartitions("t", "k", "p", "q")
    return dealt.select("t", "k", "p", "q", "mine", "rep", "fp", "pv").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """(key, fingerprint, component_id) for each row of ``docs``.

    ``component_id`` is the smallest key that links of up to ``bits`` differing
    bits reach, the row's own included.
    """
    printed = with_fingerprint(docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")), "_text", "fp", width, seed)
    return classes(cut(printed.select("_key", "fp")), bits).select(F.col("_key").alias(key), as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def classes(printed: DataFrame, bits: int = 4) -> DataFrame:
    """Add ``component_id`` to rows (_key, fp) of a written table."""
    prints = cut(printed.groupBy("fp").agg(F.min("_key").alias("rep")).filter("rep IS NOT NULL"))
    found = components(links(prints, bits))
    ids = cut(prints.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("_component")))
    joined = printed.join(ids, "fp", "left")
    return joined.withColumn("component_id", F.when(F.col("_key").isNotNull(), F.col("_component"))).drop("_component")
