"""Centroid clustering against plain loops, and on awkward rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from cliptrace.llm import centroids, queries


def brute(rows, k=40, rounds=5, seed=2):
    """Lists all the way: rows (id, components)."""
    kept = [(i, [math.floor(256 * c) if abs(c) < 1e15 else centroids.exact_floor(c) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    now = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        now = [[sum(col) // len(col) for col in zip(*mine, strict=True)] if (mine := [x for (_, x), o in zip(kept, of, strict=True) if o == n]) else c for n, c in enumerate(now)]
    last = [near(x) for _, x in kept]
    own = [sum(d for d, m in last if m == n) for n in range(len(now))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i is None, i or 0), n, d, own[n], sum(own), sha[n]) for (i, _), (d, n) in zip(kept, last, strict=True))


def got(df):
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_query_against_loops(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.op11_centroids(spark, sf_dir)) == brute(rows)


def test_odd_rows_and_ties(spark):
    rng = np.random.default_rng(1)
    near = [(i, [float(x) for x in rng.integers(-3, 4, 64) / 256]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [None, *[0.5] * 63]), (105, [math.nan, *[0.5] * 63]), (106, [math.inf, *[0.5] * 63]), (None, [0.25] * 64)]
    same = [(7, near[3][1]), (8, near[3][1]), (8, near[3][1]), (9, [0.0] * 64), (10, [-0.001] * 64)]
    rows = near + odd + same
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    for k in (5, 40):
        assert got(centroids.cluster(df, centroids=k)) == brute(rows, k)
    assert got(centroids.cluster(df.filter("vec_id < 3"))) == brute(rows[:3])  # fewer vectors than centroids
    for empty in (df.limit(0), df.filter("vec_id between 100 and 106")):
        assert centroids.cluster(empty).collect() == []
    with pytest.raises(ValueError):
        centroids.cluster(df, length=60)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(64)]) for i in range(20)] + [(20 + i, [float(x) for x in rng.standard_normal(64) * 1e7]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 6)
    assert got(centroids.cluster(df, centroids=6)) == [(*r[:2], *(x if x < 2**63 else None for x in r[2:5]), r[5]) for r in want]
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [0.0] * 64), (3, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert sorted(r["distance"] is None for r in centroids.cluster(huge, centroids=1, rounds=0).collect()) == [False, True, True]


def test_screening_loses_nothing_and_prunes():
    rng = np.random.default_rng(3)
    base = rng.integers(-200, 200, (40, 64))
    x = (base[rng.integers(0, 40, 3_000)] + rng.integers(-20, 21, (3_000, 64))).astype(np.int64)
    x[:50] = (base[0] + base[1]) // 2
    best, distance, n = centroids.nearest(x, centroids.compress(x), base.astype(np.int64))
    full = ((x[:, None, :] - base[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert n < 0.2 * full.size
    twins = np.repeat(base[:1], 3, axis=0)  # ties: the smaller number
    assert (centroids.nearest(x, centroids.compress(x), twins)[0] == 0).all()
    flat = np.full((4, 64), 1 << 27)
    assert (centroids.nearest(flat, centroids.compress(flat), np.vstack((flat[:1] - 1, flat[:1])))[1] == 0).all()
