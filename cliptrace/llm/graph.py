"""Connected components of a distributed graph, and blockwise pair work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b)
    reaches.  Nodes without edges do not appear.

    Rounds of large-star and small-star: each node hands its larger, then its
    smaller neighbours on to the smallest one it knows.  Minima are aggregated
    before they are shuffled, and a hub's neighbours are spread by adaptive
    skew joins; every round is cut off from its lineage.
    """
    spark = edges.sparkSession
    clean = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, at = written(clean.distinct())
    before = None
    for _ in range(most_rounds):
        # Large star: with both directions of all edges, larger neighbours of a
        # node are tied to the least of the node and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_at = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, large_at = written(large.filter("a <> b").distinct())
        # Small star: neighbours no larger than a node are tied to its least.
        low, low_at = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = at
        now, at = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for path in (old, least_at, large_at, low_at):
            remove(spark, path)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


class Forest:
    """Union-find over 0 .. n - 1 whose roots are the least members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite the pairs (a, b), all at once, until nothing changes."""
        up = self.up
        while len(a):
            x, y = self._root(a), self._root(b)
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))

    def _root(self, a: np.ndarray) -> np.ndarray:
        up, x = self.up, self.up[a]
        while True:
            y = up[x]
            if (x == y).all():
                up[a] = x
                return x
            x = y

    def roots(self) -> np.ndarray:
        return self._root(np.arange(len(self.up)))


def split_groups(rows: DataFrame, keys: list[str], most: int, salt: str) -> DataFrame:
    """Deal rows into work units in which all pairs of a group meet exactly once.

    Adds ``p``, ``q`` (chunk numbers, p <= q) and ``mine`` (the row's own
    chunk).  A group of up to ``most`` rows is one chunk and one unit.  A larger
    one is cut into chunks by the hash of column ``salt``; each pair of chunks,
    and each chunk with itself, is a unit of at most about ``2 * most`` rows.
    Pairs of rows of one chunk belong to the unit (p, p).
    """
    big = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most))
    here = rows.join(big, keys, "left")
    chunks = F.coalesce(F.ceil(F.col("_n") / F.lit(most)), F.lit(1)).cast("int")
    here = here.withColumn("_c", chunks).withColumn("mine", F.pmod(F.xxhash64(salt), F.col("_c")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("_o")
    return here.select("*", other).withColumns({"p": F.least("mine", "_o"), "q": F.greatest("mine", "_o")}).drop("_n", "_c", "_o")
