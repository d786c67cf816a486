"""Queries over jobs and uploads, made of orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as jb
from . import query
from .base import table

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' WHEN 'P' THEN 'queued' ELSE 'failed' END"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "completed").when(s == "O", "processing").when(s == "P", "queued").otherwise("failed")
    size = F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.concat(F.lit("video"), (F.col("o_custkey") % 50).cast("string")).alias("name"), (size % 20).alias("size"), status.alias("status"), F.col("o_orderdate").alias("started_at"), F.col("o_orderpriority").alias("p"))


@query("job_list", f"""
WITH j AS (SELECT o_orderkey AS job_id, 'video' || (o_custkey % 50) AS name, {_STATUS} AS status, CASE WHEN o_orderpriority LIKE '1%' THEN 'match' ELSE 'video' END AS kind FROM orders)
SELECT job_id, name, status, kind, CASE status WHEN 'processing' THEN 0 WHEN 'queued' THEN 1 WHEN 'completed' THEN 2 WHEN 'stopped' THEN 3 WHEN 'failed' THEN 4 ELSE 5 END AS state_rank FROM j""")
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    videos, matches = (j.filter(c).select("job_id", "name", "status", "started_at") for c in ("p NOT LIKE '1%'", "p LIKE '1%'"))
    return jb.job_list(videos, matches).drop("started_at")


@query("identity_lookup", f"""
WITH j AS (SELECT o_orderkey AS job_id, 'video' || (o_custkey % 50) AS name, CAST(floor(o_totalprice) AS BIGINT) % 20 AS size, {_STATUS} AS status, o_orderdate AS d FROM orders),
k AS (SELECT name || ':' || size AS k, job_id FROM j WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY name, size ORDER BY d DESC, job_id DESC) = 1),
u AS (SELECT c_custkey AS upload_id, 'video' || (c_custkey % 60) AS name, c_custkey % 25 AS size FROM customer)
SELECT upload_id, name, size, job_id AS known_job FROM u LEFT JOIN k ON k.k = u.name || ':' || u.size""")
def identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    uploads = table(spark, sf_dir, "customer").select(c.alias("upload_id"), F.concat(F.lit("video"), (c % 60).cast("string")).alias("name"), (c % 25).alias("size"))
    return jb.duplicates(uploads, _jobs(spark, sf_dir))


@query("job_progress", """
WITH j AS (SELECT p_partkey, p_partkey % 700 AS done, p_partkey % 1000 + p_partkey % 3 AS total, CAST(p_size % 9 AS DOUBLE) AS elapsed FROM part), f AS (SELECT *, CASE WHEN elapsed > 0 THEN done / elapsed ELSE 0 END AS fps FROM j)
SELECT p_partkey, round(fps, 6) AS fps, round(CASE WHEN fps > 0 THEN (total - done) / fps END, 6) AS eta_seconds, round(CASE WHEN total > 0 THEN least(100, done * 100e0 / total) ELSE 0 END, 6) AS pct FROM f""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    j = table(spark, sf_dir, "part").select("p_partkey", (k % 700).alias("done"), (k % 1000 + k % 3).alias("total"), (F.col("p_size") % 9).cast("double").alias("elapsed"))
    return jb.progress(j).select("p_partkey", *[F.round(c, 6).alias(c) for c in ("fps", "eta_seconds", "pct")])


@query("recovered_status", """
WITH j AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'stopped' WHEN 1 THEN 'failed' WHEN 2 THEN 'completed' WHEN 3 THEN 'processing' END AS meta, p_size % 2 = 0 AS r, p_size % 3 = 0 AS c FROM part)
SELECT p_partkey, CASE WHEN meta IN ('stopped', 'failed') THEN meta WHEN r AND NOT c THEN 'completed' WHEN c THEN 'failed' WHEN meta IS NOT NULL THEN 'failed' END AS state, CASE WHEN meta = 'processing' THEN 'failed' ELSE meta END AS match_state FROM j""")
def recovered_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    meta = F.when(k == 0, "stopped").when(k == 1, "failed").when(k == 2, "completed").when(k == 3, "processing")
    state = jb.recovered_status(meta, F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", state.alias("state"), jb.recovered_match(meta).alias("match_state"))
