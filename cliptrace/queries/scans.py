"""Queries over frames: similarities, scans, cuts, votes, matching."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import image
from ..functions.bits import hamming, js_round
from ..functions.similarity import color_znorm
from ..operators import frames as fr
from ..operators import scan as sc
from ..plans.align import CANDIDATE, MAIN
from ..plans.match import Match, align, match
from ..shared import shared_dir
from ..sources.fingerprints import FRAME_JSON, pack
from ..streaming.scenes import OUT as CHUNKS
from ..streaming.scenes import chunk_stream
from . import query
from .base import FRAMES_SQL, POINTS_SQL, SCANS_SQL, events, frames, ham_sql, in_scenes, pair_sql, points, query_frames, table


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


_full = lambda c: F.get(c, F.lit(0))


@query("hamming_topk", f"""
WITH {FRAMES_SQL},
h AS (SELECT a.fid AS si, b.fid AS mi, 1 - {ham_sql("a.variants[1].a", "b.variants[1].a")} / 64e0 AS sim FROM f a, f b WHERE a.fid % 100 = 0)
SELECT si, mi, sim, CAST(row_number() OVER (PARTITION BY si ORDER BY sim DESC, mi) AS INT) AS rank FROM h
QUALIFY row_number() OVER (PARTITION BY si ORDER BY sim DESC, mi) <= 5""")  # fmt: skip
def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.top_k(_scan(spark, sf_dir, "bits", 5, None), 5)


@query("pair_sim_weights", f"""
WITH {FRAMES_SQL} SELECT a.fid AS si, b.fid AS mi, round({pair_sql("a.variants[1]", "b.variants[1]")}, 6) AS sim FROM f a, f b WHERE a.fid % 100 = 0""")
def pair_sim_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "first")


_FIRST = "QUALIFY row_number() OVER (PARTITION BY si ORDER BY round(sim, 6) DESC, mi) = 1"


def _scan(spark: SparkSession, sf_dir: str, score: str = "fast", keep: int | None = None, digits: int | None = 6) -> DataFrame:
    f = frames(spark, sf_dir)
    f = fr.motion(f) if score in ("frame", "motion") else f
    return sc.scan(query_frames(f), f, score, keep, digits)


@query("fast_cross_best", f"WITH {SCANS_SQL} SELECT si, mi, round(sim, 6) AS sim FROM fast {_FIRST}")
def fast_cross_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.best(_scan(spark, sf_dir, keep=1))


@query("best_cross_best", f"WITH {SCANS_SQL} SELECT si, mi, round(sim, 6) AS sim FROM best {_FIRST}")
def best_cross_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.best(_scan(spark, sf_dir, "best", 1))


@query("seed_scan_topk", f"""
WITH {SCANS_SQL} SELECT si, mi, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY si ORDER BY round(sim, 6) DESC, mi) AS INT) AS rank FROM fast
QUALIFY row_number() OVER (PARTITION BY si ORDER BY round(sim, 6) DESC, mi) <= 8""")
def seed_scan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.top_k(_scan(spark, sf_dir, keep=8), 8)


_Z = """list_transform(range(0, 48), lambda k: ({g}[k + 1] - list_avg(list_transform(range(0, 16), lambda i: {g}[i * 3 + k % 3 + 1])))
 / greatest(sqrt(list_avg(list_transform(range(0, 16), lambda i: pow({g}[i * 3 + k % 3 + 1] - list_avg(list_transform(range(0, 16), lambda j: {g}[j * 3 + k % 3 + 1])), 2)))), 8e0))"""


@query("color_grid_znorm", f"WITH {FRAMES_SQL}, z AS (SELECT fid, {_Z.format(g='color')} AS z FROM f) SELECT fid, CAST(unnest(range(0, 48)) AS INT) AS k, round(unnest(z), 6) AS z FROM z")
def color_grid_znorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("fid", F.posexplode(color_znorm(F.col("color"))).alias("k", "z")).withColumn("z", F.round("z", 6))


_MIRROR3 = "list_transform(range(0, 48), lambda k: {g}[(k // 12) * 12 + (3 - (k // 3) % 4) * 3 + k % 3 + 1])"
_MIRROR1 = "list_transform(range(0, 16), lambda k: {g}[(k // 4) * 4 + 3 - k % 4 + 1])"
_DIFF = "list_sum(list_transform(range(0, {n}), lambda k: abs({a}[k + 1] - {b}[k + 1])))"


def _grids_sql(z: str, skin: str, detail: str) -> tuple[str, str, str]:
    color = f"greatest(0, 1 - {_DIFF.format(n=48, a='s.z', b=z)} / 48 / 2)"
    skins = f"(1 - {_DIFF.format(n=16, a='s.skin', b=skin)} / 16)"
    details = f"(1 - {_DIFF.format(n=16, a='s.detail', b=detail)} / greatest(1, list_max(s.detail), list_max(m.detail)) / 16)"
    return color, skins, details


_RAW, _TURNED = _grids_sql("m.z", "m.skin", "m.detail"), _grids_sql("m.tz", "m.tskin", "m.tdetail")
_SIG_SQL = (
    FRAMES_SQL
    + f""",
g AS (SELECT *, {_Z.format(g="color")} AS z, {_MIRROR1.format(g="skin")} AS tskin, {_MIRROR1.format(g="detail")} AS tdetail FROM f),
gg AS (SELECT *, {_MIRROR3.format(g="z")} AS tz FROM g),
sig AS (SELECT s.fid AS si, m.fid AS mi, greatest(({" + ".join(_RAW)}) / 3, ({" + ".join(_TURNED)}) / 3) * 100 AS sig,
  {_RAW[0]} * 100 AS color_sim, {_RAW[1]} * 100 AS skin_sim, {_RAW[2]} * 100 AS detail_sim FROM gg s, gg m WHERE s.fid % 100 = 0)"""
)


@query("signature_sim", f"WITH {_SIG_SQL} SELECT si, mi, round(sig, 6) AS sim FROM sig")
def signature_sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "signature")


_MOTION_SQL = """
mo AS (SELECT *, lag(color) OVER (PARTITION BY video_id ORDER BY si) AS before FROM f),
md AS (SELECT *, CASE WHEN before IS NOT NULL THEN list_transform(range(0, 48), lambda k: color[k + 1] - before[k + 1]) END AS t_delta FROM mo),
mt AS (SELECT *, sqrt(list_sum(list_transform(t_delta, lambda x: x * x))) AS t_mag FROM md)"""
_TEMPORAL = """CASE WHEN s.t_mag IS NULL OR m.t_mag IS NULL THEN -1e0 WHEN s.t_mag < 6 AND m.t_mag < 6 THEN 78e0 WHEN s.t_mag < 6 OR m.t_mag < 6 THEN 38e0
  ELSE (list_sum(list_transform(range(0, 48), lambda k: s.t_delta[k + 1] * m.t_delta[k + 1])) / (s.t_mag * m.t_mag) + 1) / 2 * 100 END"""


@query("frame_motion", f"WITH {FRAMES_SQL}, {_MOTION_SQL} SELECT fid, video_id, si, round(t_mag, 6) AS t_mag FROM mt")
def frame_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fr.motion(frames(spark, sf_dir)).select("fid", "video_id", "si", "t_mag"), "t_mag")


@query("temporal_sim", f"WITH {FRAMES_SQL}, {_MOTION_SQL} SELECT s.fid AS si, m.fid AS mi, round({_TEMPORAL}, 6) AS sim FROM mt s, mt m WHERE s.fid % 100 = 0")
def temporal_sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "motion")


_FRAME_SIM_SQL = f"""{SCANS_SQL}, {_SIG_SQL.replace(FRAMES_SQL + ",", "", 1)}, {_MOTION_SQL},
tt AS (SELECT s.fid AS si, m.fid AS mi, {_TEMPORAL} AS t FROM mt s, mt m WHERE s.fid % 100 = 0),
fs AS (SELECT si, mi, CASE WHEN t >= 0 THEN 0.7e0 * sim + 0.14e0 * sig + 0.16e0 * t ELSE 0.84e0 * sim + 0.16e0 * sig END AS sim FROM best JOIN sig USING (si, mi) JOIN tt USING (si, mi))"""


@query("frame_sim", f"WITH {_FRAME_SIM_SQL} SELECT si, mi, round(sim, 6) AS sim FROM fs")
def frame_sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "frame")


@query("forced_best_match", f"WITH {_FRAME_SIM_SQL} SELECT si, mi, round(sim, 6) AS sim FROM fs {_FIRST}")
def forced_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.best(_scan(spark, sf_dir, "frame", 1))


@query("frame_detail", f"""
WITH {SCANS_SQL}, {_SIG_SQL.replace(FRAMES_SQL + ",", "", 1)},
v AS (SELECT si, mi, m.name AS name, max({pair_sql("s", "m")}) AS sim FROM qv, mv GROUP BY ALL),
r AS (SELECT si, mi, max(sim) AS sim, arg_max(name, round(sim, 6) * 1000 - CASE name WHEN 'full' THEN 0 WHEN 'crop_9_16_0' THEN 1 ELSE 2 END * 1e-5) AS name FROM v GROUP BY si, mi)
SELECT si, mi, name AS crop, round(sim, 6) AS structure_sim, round(least(100, greatest(0, color_sim)), 6) AS color_sim, round(least(100, greatest(0, skin_sim)), 6) AS skin_sim, round(least(100, greatest(0, detail_sim)), 6) AS detail_sim
FROM r JOIN sig USING (si, mi)""")
def frame_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return sc.detail(query_frames(f), f)


@query("browser_compare", f"""
WITH {FRAMES_SQL}, v AS (SELECT a.fid AS si, b.fid AS mi, unnest(a.variants) AS s, b.variants AS bv FROM f a, f b WHERE a.fid % 100 = 0),
x AS (SELECT si, mi, 1 - {ham_sql("s.a", "m.a")} / 64e0 AS sim FROM (SELECT si, mi, s, unnest(bv) AS m FROM v) WHERE s.name = m.name),
y AS (SELECT si, mi, max(sim) AS sim FROM x GROUP BY si, mi)
SELECT si, mi, sim FROM y WHERE mi % 5 = 0 QUALIFY row_number() OVER (PARTITION BY si ORDER BY sim DESC, mi) = 1""")
def browser_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return sc.best(sc.scan(query_frames(f), f.filter("fid % 5 = 0"), "same_bits", 1))  # the stride of this search


@query("mean_variant_best", f"""
WITH {FRAMES_SQL}, x AS (SELECT a.fid AS si, b.fid AS mi, ({" + ".join(f"(1 - {ham_sql(f'a.variants[{i}].a', f'b.variants[{i}].a')} / 64e0)" for i in (1, 2, 3))}) / 3 AS sim FROM f a, f b WHERE a.fid % 100 = 0)
SELECT si, mi, round(sim, 6) AS sim FROM x {_FIRST}""")
def mean_variant_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.best(_scan(spark, sf_dir, "mean_bits", 1))


@query("coarse_fine_search", f"""
WITH {SCANS_SQL}, c AS (SELECT si, mi AS coarse_mi FROM fast WHERE mi % 10 = 0 {_FIRST})
SELECT si, mi, round(sim, 6) AS sim, coarse_mi FROM fast JOIN c USING (si) WHERE abs(mi - coarse_mi) <= 30 {_FIRST}""")
def coarse_fine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.coarse_fine(_scan(spark, sf_dir))


@query("local_maxima", f"""
WITH RECURSIVE {SCANS_SQL},
o AS (SELECT si, mi, round(sim, 6) AS sim, row_number() OVER (PARTITION BY si ORDER BY mi) AS rn FROM fast),
r AS (
  SELECT si, rn, mi AS last_mi, sim AS last_sim, 1 AS grp FROM o WHERE rn = 1
  UNION ALL
  SELECT o.si, o.rn, CASE WHEN o.mi - r.last_mi >= 50 OR o.sim > r.last_sim THEN o.mi ELSE r.last_mi END,
    CASE WHEN o.mi - r.last_mi >= 50 OR o.sim > r.last_sim THEN o.sim ELSE r.last_sim END, CASE WHEN o.mi - r.last_mi >= 50 THEN r.grp + 1 ELSE r.grp END
  FROM r JOIN o ON o.si = r.si AND o.rn = r.rn + 1)
SELECT si, arg_max(last_mi, rn) AS mi, arg_max(last_sim, rn) AS sim FROM r GROUP BY si, grp""")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return sc.leaders(query_frames(f), f)


_CUTS_SQL = f"""{FRAMES_SQL}, {_MOTION_SQL},
cu AS (SELECT fid, video_id, si, ts, t_mag, variants[1].a AS a, variants[1].d AS d, lag(variants[1].a) OVER w AS la, lag(variants[1].d) OVER w AS ld FROM mt WINDOW w AS (PARTITION BY video_id ORDER BY si)),
cuts AS (SELECT fid, video_id, si, ts, coalesce((1 - {ham_sql("la", "a")} / 64e0) * 100 < 25, false) OR coalesce((1 - {ham_sql("ld", "d")} / 64e0) * 100 < 28, false) OR coalesce(t_mag > 100, false) AS is_cut FROM cu),
ch AS (SELECT *, sum(CAST(is_cut AS INT)) OVER (PARTITION BY video_id ORDER BY si) AS chunk_id FROM cuts),
chunks AS (SELECT video_id, CAST(chunk_id AS BIGINT) AS chunk_id, min(si) AS "start", max(si) AS "end" FROM ch GROUP BY ALL)"""


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _full(F.col("variants"))
    return fr.scene_cuts(fr.motion(frames(spark, sf_dir)).withColumns({"a": full["a"], "d": full["d"]})).select("fid", "video_id", "si", "ts", "is_cut")


@query("scene_cuts", f"WITH {_CUTS_SQL} SELECT fid, video_id, si, is_cut FROM cuts")
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir).select("fid", "video_id", "si", "is_cut")


@query("scene_chunks", f"WITH {_CUTS_SQL} SELECT * FROM chunks")
def scene_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.scene_chunks(_cuts(spark, sf_dir))


@query("scene_chunks_stream", f"WITH {_CUTS_SQL} SELECT video_id, chunk_id, \"start\", \"end\", \"end\" - \"start\" + 1 AS frames FROM chunks")
def scene_chunks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of frames that arrive in three batches."""
    full = _full(F.col("variants"))
    rows = frames(spark, sf_dir).select("video_id", "si", full["a"].alias("a"), full["d"].alias("d"), "color", (F.lead("si").over(Window.partitionBy("video_id").orderBy("si")).isNull()).alias("last"))
    most = (rows.agg(F.max("si")).first()[0] or 0) + 1
    base = f"{shared_dir(spark)}/scenes-{uuid.uuid4().hex}"
    provider, out = "spark.sql.streaming.stateStore.providerClass", f"{base}/chunks"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):
            rows.filter(F.floor(F.col("si") * 3 / most) == k).write.mode("append").parquet(f"{base}/frames")
            arriving = chunk_stream(spark.readStream.schema(rows.schema).parquet(f"{base}/frames"))
            arriving.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return spark.read.schema(CHUNKS).parquet(out).select(F.col("video_id").cast("long").alias("video_id"), "chunk_id", "start", "end", "frames")


_FIVE = '"start" + CAST(floor({p} * ("end" - "start") / 4e0 + 0.5e0) AS BIGINT)'


@query("seed_positions", f"WITH {_CUTS_SQL} SELECT DISTINCT video_id, chunk_id, \"start\", \"end\", unnest([{', '.join(_FIVE.format(p=p) for p in range(5))}]) AS si FROM chunks")
def seed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.seed_positions(fr.scene_chunks(_cuts(spark, sf_dir)))


@query("seed_positions_dense", f"""
WITH {_CUTS_SQL} SELECT DISTINCT video_id, chunk_id, "start", "end", unnest(list_concat([{", ".join(_FIVE.format(p=p) for p in range(5))}], range("start", "end" + 1, greatest(10, CAST(ceil(("end" - "start" + 1) / 25e0) AS BIGINT))))) AS si FROM chunks""")
def seed_positions_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.seed_positions(fr.scene_chunks(_cuts(spark, sf_dir)), dense=True)


@query("gap_fill", f"""
WITH {POINTS_SQL}, a AS (SELECT *, lead(si) OVER w AS nsi, lead(mi) OVER w AS nmi, lead(sim) OVER w AS nsim FROM p WINDOW w AS (PARTITION BY seq_id ORDER BY si)),
b AS (SELECT *, unnest(CASE WHEN nsi - si BETWEEN 2 AND 3 THEN range(0, nsi - si) ELSE [0] END) AS k FROM a)
SELECT seq_id, si + k AS si, CAST(CASE WHEN k = 0 THEN mi ELSE floor(mi + k / CAST(nsi - si AS DOUBLE) * (nmi - mi) + 0.5e0) END AS BIGINT) AS mi, round(CASE WHEN k = 0 THEN sim ELSE (sim + nsim) / 2 END, 6) AS sim FROM b""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fr.fill_gaps(points(spark, sf_dir)), "sim")


@query("regression_slope", f"""
WITH {POINTS_SQL} SELECT seq_id, round(least(8, greatest(0.1e0, coalesce(CASE WHEN count(*) >= 2 AND var_pop(si) > 0 THEN regr_slope(mi, si) END, 1))), 6) AS slope FROM p GROUP BY seq_id""")
def regression_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fr.regression_slope(points(spark, sf_dir), "seq_id"), "slope")


@query("forced_groups", f"""
WITH {POINTS_SQL}, p2 AS (SELECT seq_id, si, sim, mi * CASE WHEN si % 60 < 30 THEN 1 ELSE 2 END AS mi FROM p), a AS (SELECT *, CASE WHEN abs(mi - (lag(mi) OVER w + si - lag(si) OVER w)) <= 50 THEN 0 ELSE 1 END AS fresh FROM p2 WINDOW w AS (PARTITION BY seq_id ORDER BY si)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY seq_id ORDER BY si) AS g FROM a)
SELECT seq_id, CAST(g AS BIGINT) AS grp, min(si) AS first_si, max(si) AS last_si, count(*) AS frames, round(avg(sim), 6) AS sim FROM b GROUP BY ALL""")
def forced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fr.forced_groups(points(spark, sf_dir).withColumn("mi", F.col("mi") * F.when(F.col("si") % 60 < 30, 1).otherwise(2)))
    return rows.groupBy("seq_id", "grp").agg(F.min("si").alias("first_si"), F.max("si").alias("last_si"), F.count("*").alias("frames"), F.round(F.avg("sim"), 6).alias("sim"))


@query("offset_votes", """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), d AS (SELECT doc_id, unnest(range(0, len(t) - 4)) AS mi, t FROM w WHERE len(t) >= 5),
ds AS (SELECT doc_id, mi, array_to_string(t[mi + 1 : mi + 5], ' ') AS g FROM d),
v AS (SELECT item_id, string_split(text, ' ') AS t FROM benchmark), b AS (SELECT item_id, unnest(range(0, len(t) - 4)) AS si, t FROM v WHERE len(t) >= 5),
bs AS (SELECT item_id, si, array_to_string(t[si + 1 : si + 5], ' ') AS g FROM b),
o AS (SELECT doc_id, item_id, CAST(floor((mi - si) / 8e0 + 0.5e0) AS BIGINT) AS bucket, si, mi FROM ds JOIN bs USING (g)),
a AS (SELECT doc_id, item_id, bucket, count(*) AS votes, min(si * 1000000 + mi) AS f FROM o GROUP BY ALL)
SELECT doc_id, item_id, bucket, votes, CAST(f % 1000000 - f // 1000000 AS BIGINT) AS "offset", CAST(row_number() OVER (PARTITION BY doc_id, item_id ORDER BY votes DESC, bucket) AS INT) AS rank FROM a
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY votes DESC, bucket) <= 20""")
def offset_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles meet by their 64-bit hashes; frequent ones of a document that
    no item has never leave the scan where the items are broadcast."""

    def shingles(df: DataFrame, key: str, at: str) -> DataFrame:
        words = df.select(key, F.split("text", " ").alias("t")).filter(F.size("t") >= 5)
        places = F.sequence(F.lit(1), F.size("t") - 4)
        return words.select(key, F.posexplode(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("t", i, 5), " ")))).alias(at, "g"))

    docs, items = shingles(table(spark, sf_dir, "documents"), "doc_id", "mi"), shingles(table(spark, sf_dir, "benchmark"), "item_id", "si")
    if sc.measured_bytes(items) <= sc.BROADCAST_BYTES:  # else both sides are shuffled by shingle
        items = F.broadcast(items)
    pairs = docs.join(items, "g").select("doc_id", "item_id", F.col("si").cast("long").alias("si"), F.col("mi").cast("long").alias("mi"), F.lit(1.0).alias("sim"))
    return sc.offset_votes(pairs, ["doc_id", "item_id"]).select("doc_id", "item_id", "bucket", "votes", "offset", "rank")


@query("speed_sweep_scores", f"""
WITH {SCANS_SQL}, n AS (SELECT count(*) AS n FROM q), l AS (SELECT count(*) AS len FROM f), mid AS (SELECT CAST(floor((min(si) + max(si)) / 2e0 + 0.5e0) AS BIGINT) AS mid FROM q),
g AS (SELECT slope, anchor, si, CAST(floor(anchor + slope * (si - mid) + 0.5e0) AS BIGINT) AS mi FROM (SELECT unnest([0.5e0, 0.6e0, 0.7e0, 0.8e0, 1.25e0, 1.5e0, 1.75e0, 2e0]) AS slope), (SELECT unnest(range(0, (SELECT len FROM l), 4)) AS anchor), q, mid)
SELECT slope, anchor, count(*) AS n, round(avg(sim), 6) AS score FROM g JOIN fast USING (si, mi) WHERE mi >= 0 AND mi < (SELECT len FROM l) GROUP BY slope, anchor HAVING count(*) >= greatest(2, (SELECT n // 2 FROM n))""")
def speed_sweep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    probes = query_frames(f).select(F.col("fid").alias("si"))
    mid = probes.agg(js_round((F.min("si") + F.max("si")) / F.lit(2.0)).alias("m")).first()["m"]
    got = sc.speed_sweep(query_frames(f), f, f.count(), mid)
    return _round(got, "score")


_SWEPT = """sg AS (SELECT slope, anchor, si, CAST(floor(anchor + slope * (si - mid) + 0.5e0) AS BIGINT) AS mi FROM (SELECT unnest([0.5e0, 0.6e0, 0.7e0, 0.8e0, 1.25e0, 1.5e0, 1.75e0, 2e0]) AS slope), (SELECT unnest(range(0, (SELECT len FROM l), 4)) AS anchor), q, mid),
sw AS (SELECT slope, anchor, round(avg(sim), 6) AS score FROM sg JOIN fast USING (si, mi) WHERE mi >= 0 AND mi < (SELECT len FROM l) GROUP BY slope, anchor HAVING count(*) >= greatest(2, (SELECT n // 2 FROM n))),
swo AS (SELECT *, row_number() OVER (PARTITION BY slope ORDER BY anchor) AS rn FROM sw)"""


@query("speed_sweep_seeds", f"""
WITH RECURSIVE {SCANS_SQL}, {_FRAME_SIM_SQL.replace(SCANS_SQL + ",", "", 1)}, n AS (SELECT count(*) AS n FROM q), l AS (SELECT count(*) AS len FROM f), mid AS (SELECT CAST(floor((min(si) + max(si)) / 2e0 + 0.5e0) AS BIGINT) AS mid FROM q), {_SWEPT},
r AS (
  SELECT slope, rn, anchor AS a, score AS s, 1 AS grp FROM swo WHERE rn = 1
  UNION ALL
  SELECT o.slope, o.rn, CASE WHEN o.anchor - r.a >= 50 OR o.score > r.s THEN o.anchor ELSE r.a END, CASE WHEN o.anchor - r.a >= 50 OR o.score > r.s THEN o.score ELSE r.s END, CASE WHEN o.anchor - r.a >= 50 THEN r.grp + 1 ELSE r.grp END
  FROM r JOIN swo o ON o.slope = r.slope AND o.rn = r.rn + 1),
ap AS (SELECT slope, arg_max(a, rn) AS anchor, arg_max(s, rn) AS score FROM r GROUP BY slope, grp),
t4 AS (SELECT * FROM ap QUALIFY row_number() OVER (PARTITION BY slope ORDER BY score DESC, anchor) <= 4),
bl AS (SELECT slope, anchor, round(0.5e0 * score + 0.5e0 * round(fs.sim, 6), 6) AS score FROM t4 JOIN fs ON fs.mi = anchor WHERE fs.si = (SELECT min(si) FROM q))
SELECT slope, anchor, score, CAST(row_number() OVER (ORDER BY score DESC, slope, anchor) AS INT) AS rank FROM bl QUALIFY row_number() OVER (ORDER BY score DESC, slope, anchor) <= 12""")
def speed_sweep_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first query frame stands for the one in the middle."""
    f = fr.motion(frames(spark, sf_dir))
    q = query_frames(f)
    ends = q.agg(F.min("fid").alias("a"), F.max("fid").alias("b")).first()
    swept = _round(sc.speed_sweep(q, f, f.count(), int((ends["a"] + ends["b"]) / 2 + 0.5)), "score")
    got = sc.sweep_seeds(swept, sc.scan(q.filter(F.col("fid") == ends["a"]), f, "frame", digits=6))
    return _round(got, "score")


@query("nearest_timestamp", f"""
WITH {FRAMES_SQL}, r AS (SELECT video_id, min(ts) AS a, max(ts) AS b FROM f GROUP BY video_id),
t AS (SELECT video_id, a + (b - a) * p / 100e0 AS target FROM r, (SELECT unnest([0, 10, 25, 50, 75, 90]) AS p))
SELECT video_id, round(target, 6) AS target, fid, ts FROM f JOIN t USING (video_id) QUALIFY row_number() OVER (PARTITION BY video_id, target ORDER BY abs(ts - target), ts) = 1""")
def nearest_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("video_id", "fid", "ts")
    ends = f.groupBy("video_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    targets = ends.select("video_id", F.explode(F.array(*[F.lit(p) for p in (0, 10, 25, 50, 75, 90)])).alias("p"), "a", "b").select("video_id", (F.col("a") + (F.col("b") - F.col("a")) * F.col("p") / 100.0).alias("target"))
    return _round(sc.nearest(f, targets, key=["video_id"]), "target")


@query("frame_duration", """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events), s AS (SELECT user_id, t - lag(t) OVER w AS step, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id // 5, event_id % 5 DESC)),
l AS (SELECT user_id, list_sort(list(step)) AS x FROM s WHERE n BETWEEN 2 AND 201 AND step > 0 GROUP BY user_id)
SELECT user_id, round(x[len(x) // 2 + 1], 5) AS duration FROM l""")
def frame_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Neighbours out of order: some steps of time are negative.
    e = events(spark, sf_dir).select("user_id", (F.unix_micros("ts") / 1e6).alias("ts"), (F.floor(F.col("event_id") / 5) * 5 + 4 - F.col("event_id") % 5).alias("si"))
    return fr.frame_duration(e, "user_id").withColumn("duration", F.round("duration", 5))


@query("rolling_mean_50", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS rolling FROM events")
def rolling_mean_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fr.rolling_mean(table(spark, sf_dir, "events"), "value", "user_id", ["ts", "event_id"])
    return got.select("event_id", F.round("rolling", 9).alias("rolling"))


def _shorts_and_movie(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of a hundred frames are shorts; all frames are the movie, in scenes."""
    movie = in_scenes(frames(spark, sf_dir).withColumn("si", F.col("fid")).withColumn("ts", F.col("fid") / F.lit(25.0)))
    short = movie.withColumn("video_id", F.floor(F.col("fid") / 100).cast("long")).withColumn("si", F.col("fid") % 100).withColumn("ts", F.col("si") / F.lit(25.0))
    return short, movie


def _pipeline(spark: SparkSession, sf_dir: str, profile) -> Match:
    return match(*_shorts_and_movie(spark, sf_dir), profile)


def _aligned(spark: SparkSession, sf_dir: str, profile) -> DataFrame:
    return align(*_shorts_and_movie(spark, sf_dir), profile)


def _found(found: DataFrame) -> DataFrame:
    times = [F.round(c, 6).alias(c) for c in ("short_start", "short_end", "movie_start", "movie_end", "confidence", "speed_ratio")]
    return found.select("match_id", "seg_id", *times, "frame_count", "gap_count", "is_approximate")


@query("match_pipeline_main")
def match_pipeline_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_pipeline(spark, sf_dir, MAIN).segments)


@query("match_pipeline_candidate")
def match_pipeline_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_pipeline(spark, sf_dir, CANDIDATE).segments)


@query("match_alternates")
def match_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_pipeline(spark, sf_dir, MAIN).alternates)


@query("match_pool")
def match_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_pipeline(spark, sf_dir, MAIN).pool)


@query("match_details")
def match_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pipeline(spark, sf_dir, MAIN).segments
    sims = [F.round(f"detail.{c}", 6).alias(c) for c in ("structure_sim", "color_sim", "skin_sim", "detail_sim")]
    return found.select("match_id", "seg_id", "best_si", "best_mi", "detail.crop", *sims, "detail.short_hash", "detail.movie_hash")


@query("match_unmatched")
def match_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)  # with their colors, which no other frame shares
    movie = f.filter("video_id < 5").withColumn("si", F.col("fid")).withColumn("ts", F.col("fid") / F.lit(25.0))
    return match(f.filter("video_id >= 5"), movie, MAIN).unmatched


@query("match_library", f"""
WITH {FRAMES_SQL}, n AS (SELECT video_id, count(*) AS n FROM f WHERE si BETWEEN 10 AND 39 GROUP BY video_id)
SELECT video_id || '/' || video_id AS match_id, 0e0 AS short_start, round(n / 25e0, 6) AS short_end, 0.4e0 AS movie_start, round((n + 10) / 25e0, 6) AS movie_end, 100e0 AS confidence, CAST(n AS INT) AS frame_count FROM n WHERE n >= 12""")
def match_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every video against the library of all videos: each is found
    exactly in the video that it was cut from, and in no other."""
    f = in_scenes(frames(spark, sf_dir), "video_id")
    pieces = f.filter("si BETWEEN 10 AND 39").withColumns({"si": F.col("si") - 10, "ts": F.col("ts") - 0.4})
    long = pieces.groupBy("video_id").count().filter("count >= 12").select("video_id")
    found = match(pieces.join(long, "video_id", "left_semi"), f, MAIN, single=False).segments.filter("NOT is_approximate")
    times = [F.round(c, 6).alias(c) for c in ("short_start", "short_end", "movie_start", "movie_end", "confidence")]
    return found.select("match_id", *times, "frame_count")


def _walked(found: DataFrame) -> DataFrame:
    return found.select("match_id", "seg_id", F.explode("sequence").alias("x")).select("match_id", "seg_id", "x.si", "x.mi", F.round("x.similarity", 6).alias("sim"))


@query("walk_full_coverage")
def walk_full_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(_aligned(spark, sf_dir, MAIN).filter("kind = 'alternate'"))


@query("walk_bidirectional")
def walk_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of the walks from seeds, both ways, gaps filled."""
    return _walked(_aligned(spark, sf_dir, MAIN).filter("kind = 'segment' AND stage LIKE 'pass%'"))


@query("consensus_votes", f"""
WITH RECURSIVE {SCANS_SQL}, o AS (SELECT si, mi, round(sim, 6) AS sim, row_number() OVER (PARTITION BY si ORDER BY mi) AS rn FROM best),
r AS (
  SELECT si, rn, mi AS m, sim AS s, 1 AS grp FROM o WHERE rn = 1
  UNION ALL
  SELECT o.si, o.rn, CASE WHEN o.mi - r.m >= 50 OR o.sim > r.s THEN o.mi ELSE r.m END, CASE WHEN o.mi - r.m >= 50 OR o.sim > r.s THEN o.sim ELSE r.s END, CASE WHEN o.mi - r.m >= 50 THEN r.grp + 1 ELSE r.grp END
  FROM r JOIN o ON o.si = r.si AND o.rn = r.rn + 1),
lm AS (SELECT si, arg_max(m, rn) AS mi, arg_max(s, rn) AS sim FROM r GROUP BY si, grp),
v AS (SELECT CAST(floor((mi - si) / 8e0 + 0.5e0) AS BIGINT) AS bucket, si, mi, sim FROM lm QUALIFY row_number() OVER (PARTITION BY si ORDER BY sim DESC, mi) <= 10),
g AS (SELECT bucket, count(*) AS votes, sum(sim) AS s FROM v GROUP BY bucket)
SELECT bucket, votes, round(s, 4) AS sim_sum, CAST(row_number() OVER (ORDER BY votes DESC, round(s, 6) DESC, bucket) AS INT) AS rank FROM g QUALIFY row_number() OVER (ORDER BY votes DESC, round(s, 6) DESC, bucket) <= 20""")
def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    top = sc.top_k(sc.leaders(query_frames(f), f, "best"), 10)
    votes = sc.offset_votes(top.withColumn("probe_set", F.lit(0)), ["probe_set"])
    return votes.select("bucket", "votes", F.round("sim_sum", 4).alias("sim_sum"), "rank")


@query("ndjson_frames", f"WITH {FRAMES_SQL} SELECT fid, CAST(len(variants) AS INT) AS variants, {ham_sql('variants[1].a', 'variants[1].fa')} AS distance FROM f")
def ndjson_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as JSON lines, parsed and packed again."""
    text = lambda words: F.array_join(F.transform(words, lambda w: F.reverse(F.lpad(F.bin(w), 32, "0"))), "")
    one = lambda v: F.struct(v["name"].alias("key"), F.struct(text(v["a"]).alias("hash"), text(v["d"]).alias("dhash"), text(v["fa"]).alias("fhash"), text(v["fd"]).alias("fdhash"), text(v["p"]).alias("phash")).alias("value"))
    rows = frames(spark, sf_dir).select("fid", F.to_json(F.struct((F.col("fid") + 1).cast("int").alias("frameIndex"), F.col("ts").alias("timestamp"), F.map_from_entries(F.transform("variants", one)).alias("variants"))).alias("line"))
    parsed = rows.select(F.lit("v").alias("video_id"), F.from_json("line", FRAME_JSON).alias("j")).select("video_id", "j.*")
    full = _full(F.col("variants"))
    return pack(parsed).select(F.col("si").alias("fid"), F.size("variants").alias("variants"), hamming(full["a"], full["fa"]).alias("distance"))


@query("crop_labels", """
SELECT DISTINCT p_size, CASE WHEN p_size % 4 = 0 THEN 'Full Frame' WHEN p_size % 4 = 1 THEN '9:16 Crop ' || (p_size % 5 + 1) WHEN p_size % 4 = 2 THEN 'Zoom 1.25x Left' ELSE 'other' END AS label FROM part""")
def crop_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    name = F.when(n % 4 == 0, "full").when(n % 4 == 1, F.concat(F.lit("crop_9_16_"), (n % 5).cast("string"))).when(n % 4 == 2, "zoom_1_25_left").otherwise("other")
    return table(spark, sf_dir, "part").select("p_size", image.crop_label(name).alias("label")).distinct()
