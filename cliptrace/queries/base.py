"""Frames and segments made from the tables at hand.

The tables hold no video.  Vectors of ``embeddings`` stand for frames (a label
is a video), ``events`` for segments and request logs.  Each rule is given
twice: as a DataFrame, and as SQL for the check.  A search takes as queries the
frames whose id is divisible by 100, against all frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import pack

#: Rotations of a vector that stand for variants of a frame.
VARIANTS = {"full": 0, "crop_9_16_0": 8, "zoom_1_5_center": 16}
QUERY_STEP = 100
#: Frames of a scene, and what part of a frame's colors is its own.
SCENE, OWN = 250, 0.125


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with its times as instants, taken for UTC where the table
    names no zone."""
    df = table(spark, sf_dir, "events")
    if dict(df.dtypes)["ts"] == "timestamp_ntz":
        df = df.withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp"))
    return df


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, video_id, si, ts, variants, color, skin, detail)."""
    x = lambda k: F.get("x", k.cast("int"))
    made = []
    for name, r in VARIANTS.items():
        at = lambda k, r=r: x((k + r) % 64)
        turned = lambda k, at=at: at(63 - k % 64)
        made.append(F.struct(
            F.lit(name).alias("name"),
            pack(lambda k, at=at: at(k) > 0, 64).alias("a"),
            pack(lambda k, at=at: at(k + 1) > at(k), 64).alias("d"),
            pack(lambda k, t=turned: t(k) > 0, 64).alias("fa"),
            pack(lambda k, t=turned: t(k + 1) > t(k), 64).alias("fd"),
            pack(lambda k, at=at: at(k) + at(k + 7) > 0, 64).alias("p"),
        ))
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("fid"), F.col("label").cast("long").alias("video_id"),
        (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("si"),
        F.transform("embedding", lambda e: e.cast("double")).alias("x"),
    ).repartition(spark.sparkContext.defaultParallelism)  # fmt: skip  by cost: what follows computes much on few bytes
    return rows.select(
        "fid", "video_id", "si", (F.col("si") / F.lit(25.0)).alias("ts"), F.array(*made).alias("variants"),
        F.transform(F.sequence(F.lit(0), F.lit(47)), lambda k: F.floor((x(k) + 1) * 127.5).cast("double")).alias("color"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.abs(x(k + 48))).alias("skin"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: x(k + 16) * x(k + 16) * 255).alias("detail"),
    )


def in_scenes(frames: DataFrame, *video: str) -> DataFrame:
    """Frames with colors as a video has them: mostly those of their scene's first
    frame, so that they change slowly, and cut where a scene begins.  (Those of
    vectors alone are unrelated: each frame would be a scene.)"""
    key = [*video, "scene"]
    cut = frames.withColumn("scene", F.floor(F.col("si") / SCENE))
    looks = cut.groupBy(*key).agg(F.min_by("color", "si").alias("look"))
    color = F.zip_with("color", "look", lambda own, look: OWN * own + (1 - OWN) * look)
    return cut.join(looks, key, "left").withColumn("color", color).drop("scene", "look")


def _word(bit: str, first: int) -> str:
    return f"CAST(list_sum(list_transform(range({first}, {first + 32}), lambda k: CASE WHEN {bit} THEN CAST(1 AS BIGINT) << (k - {first}) ELSE 0 END)) AS BIGINT)"


def _words(bit: str) -> str:
    return f"[{_word(bit, 0)}, {_word(bit, 32)}]"


def _variant_sql(name: str, r: int) -> str:
    at = lambda k: f"x[(({k}) + {r}) % 64 + 1]"
    turned = lambda k: at(f"63 - ({k}) % 64")
    return (
        f"{{'name': '{name}', 'a': {_words(at('k') + ' > 0')}, 'd': {_words(at('k + 1') + ' > ' + at('k'))}, 'fa': {_words(turned('k') + ' > 0')}, "
        f"'fd': {_words(turned('k + 1') + ' > ' + turned('k'))}, 'p': {_words(at('k') + ' + ' + at('k + 7') + ' > 0')}}}"
    )


#: CTEs that end in ``f``: the frames.
FRAMES_SQL = f"""
f0 AS (SELECT vec_id AS fid, CAST(label AS BIGINT) AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS si, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings),
f AS (SELECT fid, video_id, si, si / 25e0 AS ts, [{", ".join(_variant_sql(n, r) for n, r in VARIANTS.items())}] AS variants,
  list_transform(range(0, 48), lambda k: floor((x[k + 1] + 1) * 127.5e0)) AS color,
  list_transform(range(0, 16), lambda k: abs(x[k + 49])) AS skin,
  list_transform(range(0, 16), lambda k: x[k + 17] * x[k + 17] * 255) AS detail FROM f0)"""


def ham_sql(a: str, b: str) -> str:
    """Differing bits of two packed vectors of two words."""
    return f"(bit_count(xor({a}[1], {b}[1])) + bit_count(xor({a}[2], {b}[2])))"


def pair_sql(s: str, m: str) -> str:
    """Similarity of two variants."""
    sim = lambda x, y: f"(1 - {ham_sql(f'{s}.{x}', f'{m}.{y}')} / 64e0)"
    return f"(greatest(0.25e0 * {sim('a', 'a')} + 0.35e0 * {sim('d', 'd')} + 0.4e0 * {sim('p', 'p')}, 0.55e0 * {sim('a', 'fa')} + 0.45e0 * {sim('d', 'fd')}) * 100)"


#: CTEs that end in ``fast`` and ``best``: (si, mi, sim) of query frames.
SCANS_SQL = (
    FRAMES_SQL
    + f""",
q AS (SELECT fid AS si, variants AS sv FROM f WHERE fid % {QUERY_STEP} = 0),
mv AS (SELECT fid AS mi, unnest(variants) AS m FROM f),
fast AS (SELECT si, mi, max({pair_sql("sv[1]", "m")}) AS sim FROM q, mv GROUP BY si, mi),
qv AS (SELECT si, unnest(sv) AS s FROM q),
best AS (SELECT si, mi, max({pair_sql("s", "m")}) AS sim FROM qv, mv GROUP BY si, mi)"""
)


def query_frames(df: DataFrame) -> DataFrame:
    """The frames that a search asks for."""
    return df.filter(F.col("fid") % QUERY_STEP == 0)


_SEGMENTS = """SELECT CAST(user_id AS BIGINT) AS match_id, event_id AS seg_id,
  CAST(event_id % 240 AS DOUBLE) * 0.48e0 AS short_start,
  CAST(event_id % 240 AS DOUBLE) * 0.48e0 + 0.3e0 + CAST(event_id % 7 AS DOUBLE) * 0.15e0 AS short_end,
  CAST(event_id % 240 AS DOUBLE) * 0.5e0 + CAST(event_id % 5 AS DOUBLE) * 1.5e0 AS movie_start,
  CAST(event_id % 240 AS DOUBLE) * 0.5e0 + CAST(event_id % 5 AS DOUBLE) * 1.5e0 + 0.3e0 + CAST(event_id % 7 AS DOUBLE) * 0.16e0 AS movie_end,
  value / 5e0 AS confidence, CAST(5 + event_id % 40 AS INT) AS frame_count, CAST(event_id % 4 AS INT) AS gap_count,
  0.9e0 + CAST(event_id % 5 AS DOUBLE) * 0.05e0 AS speed_ratio, event_id % 3 = 0 AS is_approximate, CAST(event_id % 6 AS INT) AS kind
FROM {events}"""
#: A CTE ``s``: the segments.
SEGMENTS_SQL = "s AS (" + _SEGMENTS.format(events="events") + ")"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments: events of a user are those of a match."""
    return spark.sql(_SEGMENTS.format(events="{e}"), e=table(spark, sf_dir, "events"))


_POINTS = """SELECT CAST(user_id AS BIGINT) AS seq_id, event_id % 240 AS si, min((event_id % 240) * 2 + event_id % 7) AS mi, max(value / 5e0) AS sim
FROM {events} GROUP BY user_id, event_id % 240"""
#: A CTE ``p``: matched points (seq_id, si, mi, sim).
POINTS_SQL = "p AS (" + _POINTS.format(events="events") + ")"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched points of a sequence for each user."""
    return spark.sql(_POINTS.format(events="{e}"), e=table(spark, sf_dir, "events"))


def fold_sql(source: str, key: str, order: str, fields: list[str], clash: str, limit: int | None = None, ctes: str = "", out: str | None = None) -> str:
    """SQL of a greedy choice: rows of ``source`` in order are kept unless
    ``clash`` (of the row ``o`` and a kept one ``k``) holds for a kept one."""
    item = "{" + ", ".join(f"'{c}': o.{c}" for c in fields) + "}"
    room = "" if limit is None else f" AND len(r.kept) < {limit}"
    return f"""
WITH RECURSIVE {ctes}{", " if ctes else ""}
o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}),
w AS (SELECT *, {item} AS item FROM o),
r AS (
  SELECT {key}, rn, [item] AS kept FROM w WHERE rn = 1
  UNION ALL
  SELECT o.{key}, o.rn, CASE WHEN len(list_filter(r.kept, lambda k: {clash})) = 0{room} THEN list_append(r.kept, o.item) ELSE r.kept END
  FROM r JOIN w o ON o.{key} = r.{key} AND o.rn = r.rn + 1
),
z AS (SELECT {key}, arg_max(kept, rn) AS kept FROM r GROUP BY {key}),
u AS (SELECT {key}, unnest(range(0, len(kept))) AS kept_idx, unnest(kept) AS x FROM z)
SELECT {key}, kept_idx, {", ".join(out or [f"x.{c} AS {c}" for c in fields])} FROM u"""
