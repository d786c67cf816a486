"""Queries over embeddings: search, group maxima, ranking, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import l2_normalize
from ..operators import ranking as rk
from . import query
from .base import table

_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings)"
_COS = "list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e))"
_SIMS = f"{_V}, c AS (SELECT a.vec_id AS q_id, b.vec_id AS id, b.label, round({_COS}, 6) AS score FROM v a, v b WHERE a.vec_id % 100 = 0)"


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The query vectors, and all vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return e.filter("id % 100 = 0").select(F.col("id").alias("q_id"), "embedding"), e


@query("cosine_topk", f"WITH {_SIMS} SELECT q_id, id, score, CAST(row_number() OVER w AS INT) AS rank FROM c QUALIFY row_number() OVER w <= 10 WINDOW w AS (PARTITION BY q_id ORDER BY score DESC, id)".replace("QUALIFY row_number() OVER w <= 10 WINDOW w AS (PARTITION BY q_id ORDER BY score DESC, id)", "WINDOW w AS (PARTITION BY q_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.filter("id % 100 = 0").select(F.col("id").alias("q_id"), "embedding")
    return rk.cosine_topk(q, e, 10).withColumn("score", F.round("score", 6))


@query("l2_normalize", f"WITH {_V} SELECT vec_id, CAST(unnest(range(0, 64)) AS INT) AS k, round(unnest(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))), 6) AS x FROM v")
def l2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("k", "x")).withColumn("x", F.round("x", 6))


@query("group_max_cosine", f"WITH {_SIMS} SELECT q_id, label, max(score) AS max_sim, min(CASE WHEN score = m THEN id END) AS best_index FROM (SELECT *, max(score) OVER (PARTITION BY q_id, label) AS m FROM c) GROUP BY q_id, label")
def group_max_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.group_best(*_asked(spark, sf_dir), "label")


@query("embedding_gate", f"WITH {_SIMS}, g AS (SELECT q_id, label, round(median(score), 6) AS median_sim, max(score) AS max_sim FROM c GROUP BY ALL) SELECT *, CASE WHEN median_sim >= 0.93 THEN 'accept' WHEN max_sim < 0.55 THEN 'reject' ELSE 'ambiguous' END AS decision FROM g")
def embedding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("median_sim")  # half of an odd sum of millionths: rounded as the SQL does, not by its decimals
    return rk.group_gate(*_asked(spark, sf_dir), "label").withColumn("median_sim", F.signum(m) * F.floor(F.abs(m) * 1e6 + 0.5) / 1e6)


#: Pools of candidates: lines of an order; every seventh pool is saturated.
_POOLS = """SELECT user_id AS pool, event_id AS cand_idx, CASE WHEN event_id % 13 = 0 THEN NULL WHEN user_id % 7 = 0 THEN 0.9995e0 ELSE floor(value / 10) / 50e0 END AS score,
  CAST(event_id % 101 AS DOUBLE) / 101e0 AS dino FROM {events}"""


@query("rank_candidates", f"""
WITH c AS ({_POOLS.format(events="events")}), r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC NULLS LAST, cand_idx) AS r, count(score) OVER (PARTITION BY pool) AS n, max(score) OVER (PARTITION BY pool) AS hi, min(score) OVER (PARTITION BY pool) AS lo FROM c),
t AS (SELECT *, max(CASE WHEN r = 1 THEN score END) OVER p AS s1, max(CASE WHEN r = 2 THEN score END) OVER p AS s2, max(CASE WHEN r = 1 THEN dino END) OVER p AS d1, max(CASE WHEN r = 2 THEN dino END) OVER p AS d2, row_number() OVER (PARTITION BY pool ORDER BY dino DESC NULLS LAST, r) AS rd,
  coalesce(n >= 2 AND hi >= 0.999 AND hi - lo < 1e-4, false) AS degenerate FROM r WINDOW p AS (PARTITION BY pool)),
u AS (SELECT *, coalesce(n >= 2 AND s1 - s2 < 0.05e0 AND d2 > d1, false) AS swap FROM t)
SELECT pool, cand_idx, n, degenerate, CAST(CASE WHEN degenerate THEN rd WHEN swap AND r = 1 THEN 2 WHEN swap AND r = 2 THEN 1 ELSE r END AS INT) AS rank FROM u""")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.sql(_POOLS.format(events="{e}"), e=table(spark, sf_dir, "events"))
    return rk.rank_candidates(c, ["pool"]).select("pool", "cand_idx", "n", "degenerate", "rank")


#: Candidates of a pool: vectors are the variants, four a candidate; a third of
#: the candidates share a short frame.
_PARTS = """ca AS (SELECT DISTINCT vec_id // 4 AS cand_id, (vec_id // 4) % 17 * 3 AS short_key FROM e), sh AS (SELECT vec_id AS short_key, v FROM e WHERE vec_id < 60),
va AS (SELECT vec_id // 4 AS cand_id, CAST(vec_id % 4 AS INT) AS variant_idx, v FROM e WHERE vec_id % 40 >= 4)"""


@query("pool_scores", f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), {_PARTS},
p AS (SELECT cand_id, variant_idx, round(list_cosine_similarity(sh.v, va.v), 6) AS s FROM ca JOIN sh USING (short_key) JOIN va USING (cand_id)),
b AS (SELECT cand_id, s AS score, variant_idx AS best_variant FROM p QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY s DESC, variant_idx) = 1)
SELECT cand_id, coalesce(score, -1) AS score, coalesce(best_variant, 0) AS best_variant FROM ca LEFT JOIN b USING (cand_id)""")
def pool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 4).alias("cand_id"), "embedding")
    candidates = e.select("cand_id", (F.col("cand_id") % 17 * 3).alias("short_key")).distinct()
    shorts = e.filter("vec_id < 60").select(F.col("vec_id").alias("short_key"), "embedding")
    variants = e.filter("vec_id % 40 >= 4").select("cand_id", (F.col("vec_id") % 4).cast("int").alias("variant_idx"), "embedding")
    return rk.pool_scores(candidates, shorts.unionByName(shorts), variants).withColumn("score", F.round("score", 6))
