"""Queries over pixels and grids: crops, hashes, signatures, subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import image, pixels
from ..functions.bits import char_sim, hamming, pack_text
from . import query
from .base import table

_EVEN = "({x} - ({x}) % 2)"
_ROUND = "CAST(floor({x} + 0.5e0) AS BIGINT)"


def _even_round(x: str) -> str:
    return _EVEN.format(x=_ROUND.format(x=x))


def _clamped(x: str, low: str, high: str) -> str:
    return _EVEN.format(x=f"least({high}, greatest({low}, {_ROUND.format(x=x)}))")


def _crops_sql() -> str:
    parts = ["SELECT p_partkey, w, h, 0 AS crop_idx, 'full' AS name, 0 AS sx, 0 AS sy, w AS sw, h AS sh FROM z"]
    crop = _even_round("h * 9e0 / 16")
    for i in range(5):
        sx = _even_round(f"(w - cw) / 4e0 * {i}")
        parts.append(f"SELECT p_partkey, w, h, {1 + i}, 'crop_9_16_{i}', CASE WHEN cw <= w THEN {sx} ELSE 0 END, 0, CASE WHEN cw <= w THEN cw ELSE w END, h FROM z")
    n = 6
    for name, zoom, places in (("zoom_1_25", "1.25e0", ("center", "left", "right")), ("zoom_1_5", "1.5e0", ("center", "left", "right")), ("zoom_2_0", "2e0", ("center",))):
        z = f"(SELECT *, {_clamped(f'w / {zoom}', '1', 'w')} AS zw, {_clamped(f'h / {zoom}', '1', 'h')} AS zh FROM z)"
        sy = _clamped("(h - zh) / 2e0", "0", "h - zh")
        at = {"center": _clamped("(w - zw) / 2e0", "0", "w - zw"), "left": "0", "right": _EVEN.format(x="greatest(w - zw, 0)")}
        for p in places:
            parts.append(f"SELECT p_partkey, w, h, {n}, '{name}_{p}', {at[p]}, {sy}, zw, zh FROM {z}")
            n += 1
    return f"WITH y AS (SELECT p_partkey, 200 + p_size * 37 + p_partkey % 500 AS w, 120 + p_partkey % 1000 AS h FROM part), z AS (SELECT *, {crop} AS cw FROM y) " + " UNION ALL ".join(parts)


@query("crop_rects", _crops_sql())
def crop_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "part").select("p_partkey", (F.lit(200) + F.col("p_size") * 37 + F.col("p_partkey") % 500).cast("long").alias("w"), (F.lit(120) + F.col("p_partkey") % 1000).cast("long").alias("h"))
    return image.crop_rects(sized)


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray grids of 16x16: four vectors that follow each other."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("grid_id"), "vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("double")).alias("g"))
    got = e.groupBy("grid_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "g"))), lambda r: r["g"])).alias("gray"))
    return got.filter(F.size("gray") == 256)


_GRIDS = """e AS (SELECT vec_id // 4 AS grid_id, vec_id, list_transform(embedding, lambda x: floor((CAST(x AS DOUBLE) + 1) * 127.5e0)) AS g FROM embeddings),
g AS (SELECT * FROM (SELECT grid_id, flatten(list(g ORDER BY vec_id)) AS gray FROM e GROUP BY grid_id) WHERE len(gray) = 256)"""


def _blur_sql(g: str) -> str:
    terms, count = [], []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            ok = f"(i // 16 + {dy} BETWEEN 0 AND 15 AND i % 16 + {dx} BETWEEN 0 AND 15)"
            terms.append(f"CASE WHEN {ok} THEN {g}[i + {dy * 16 + dx} + 1] ELSE 0 END")
            count.append(f"CAST({ok} AS INT)")
    return f"list_transform(range(0, 256), lambda i: ({' + '.join(terms)}) / ({' + '.join(count)}))"


_HASHED = f"""{_GRIDS}, m AS (SELECT *, list_sum(gray) / 256 AS mean FROM g), fl AS (SELECT *, list_sum(list_transform(gray, lambda x: (x - mean) * (x - mean))) / 256 < 1 AS flat FROM m),
b1 AS (SELECT grid_id, mean, flat, {_blur_sql("gray")} AS x1 FROM fl), b2 AS (SELECT grid_id, mean, flat, {_blur_sql("x1")} AS x2 FROM b1), b AS (SELECT grid_id, mean, flat, {_blur_sql("x2")} AS x FROM b2),
bm AS (SELECT *, list_transform(range(0, 256), lambda i: x[(i // 16) * 16 + 15 - i % 16 + 1]) AS y FROM b)"""


def _bits(n: int, test: str) -> str:
    return f"CASE WHEN flat THEN repeat('0', {n}) ELSE array_to_string(list_transform(range(0, {n}), lambda i: CASE WHEN {test} THEN '1' ELSE '0' END), '') END"


def _dhash(x: str) -> str:
    across, down = f"{x}[(i // 15) * 16 + i % 15 + 2] > {x}[(i // 15) * 16 + i % 15 + 1]", f"{x}[i - 240 + 17] > {x}[i - 240 + 1]"
    return _bits(480, f"CASE WHEN i < 240 THEN {across} ELSE {down} END")


@query("ahash_bits", f"WITH {_HASHED} SELECT grid_id, flat, {_bits(256, 'x[i + 1] >= mean')} AS hash, {_bits(256, 'y[i + 1] >= mean')} AS fhash FROM bm")
def ahash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.hash_features(_grids(spark, sf_dir)).select("grid_id", "flat", "hash", "fhash")


@query("dhash_bits", f"WITH {_HASHED} SELECT grid_id, {_dhash('x')} AS dhash, {_dhash('y')} AS fdhash FROM bm")
def dhash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.hash_features(_grids(spark, sf_dir)).select("grid_id", "dhash", "fdhash")


_COEF = "list_transform(range(0, 64), lambda c: list_sum(list_transform(range(0, 256), lambda i: x[i + 1] * cos((2 * (i // 16) + 1) * (c // 8) * pi() / 32) * cos((2 * (i % 16) + 1) * (c % 8) * pi() / 32))))"


@query("phash_bits", f"WITH {_HASHED}, co AS (SELECT grid_id, flat, {_COEF} AS c FROM b), me AS (SELECT *, list_sort(c[2:64])[32] AS med FROM co) SELECT grid_id, {_bits(64, 'c[i + 1] > med')} AS phash FROM me")
def phash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.hash_features(_grids(spark, sf_dir)).select("grid_id", "phash")


@query("flat_guard", f"WITH {_GRIDS}, d AS (SELECT grid_id, list_transform(gray, lambda x: CASE WHEN grid_id % 3 = 0 THEN 128 + x % 2 * 0.5e0 ELSE x END) AS q FROM g), m AS (SELECT *, list_sum(q) / 256 AS mean FROM d) SELECT grid_id, list_sum(list_transform(q, lambda x: (x - mean) * (x - mean))) / 256 < 1 AS flat FROM m")
def flat_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dull = F.transform("gray", lambda x: F.when(F.col("grid_id") % 3 == 0, 128 + x % 2 * 0.5).otherwise(x))
    return _grids(spark, sf_dir).withColumn("q", dull).select("grid_id", image.is_flat(F.col("q")).alias("flat"))


@query("hash_words", f"WITH {_HASHED}, h AS (SELECT grid_id, list_transform(range(0, 256), lambda i: x[i + 1] >= mean) AS u, list_transform(range(0, 256), lambda i: y[i + 1] >= mean) AS v FROM bm WHERE NOT flat) SELECT grid_id, CAST(list_sum(list_transform(range(0, 256), lambda i: CAST(u[i + 1] <> v[i + 1] AS INT))) AS INT) AS distance FROM h")
def hash_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = pixels.hash_features(_grids(spark, sf_dir)).filter("NOT flat")
    return h.select("grid_id", hamming(pack_text(F.col("hash")), pack_text(F.col("fhash"))).cast("int").alias("distance"))


@query("char_similarity", "WITH p AS (SELECT a.s_suppkey, r_regionkey, a.s_name AS x, r_name AS y FROM supplier a, region) SELECT s_suppkey, r_regionkey, round(list_sum(list_transform(range(1, length(x) + 1), lambda i: CAST(i <= length(y) AND substring(x, i, 1) = substring(y, i, 1) AS INT))) / CAST(length(x) AS DOUBLE), 6) AS sim FROM p")
def char_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")  # five rows
    return table(spark, sf_dir, "supplier").join(F.broadcast(regions)).select("s_suppkey", "r_regionkey", F.round(char_sim(F.col("s_name"), F.col("r_name")), 6).alias("sim"))


def _pixels_sql(side: int) -> str:
    return f"""px AS (SELECT CAST(s_suppkey AS INT) AS frame, x, y, (x * (s_suppkey + 1) * 31 + y * 97) AS r0, (y * (s_suppkey + 1) * 67 + x * 41) AS g0, x * y * 7 + s_suppkey * 113 AS b0, s_suppkey AS f FROM supplier, (SELECT unnest(range(0, {side})) AS x), (SELECT unnest(range(0, {side})) AS y)),
p AS (SELECT frame, x, y, xor(r0, f * 53) & 255 AS r, xor(g0, f * 29) & 255 AS g, xor(b0, 128) & 255 AS b FROM px)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.test_pixels(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("frame")), 16, 16)


@query("test_frames", f"WITH {_pixels_sql(16)} SELECT frame, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum(r * (y * 16 + x)) AS BIGINT) AS placed FROM p GROUP BY frame")
def test_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).groupBy("frame").agg(F.sum("r").alias("r"), F.sum("g").alias("g"), F.sum("b").alias("b"), F.sum(F.col("r") * (F.col("y") * 16 + F.col("x"))).alias("placed"))


@query("signature_grid", f"""
WITH {_pixels_sql(16)}, c AS (SELECT frame, CAST((y // 4) * 4 + x // 4 AS INT) AS cell, r, g, b, 0.299e0 * r + 0.587e0 * g + 0.114e0 * b AS l FROM p), a AS (SELECT *, avg(l) OVER (PARTITION BY frame, cell) AS m FROM c)
SELECT frame, cell, round(avg(r), 5) AS r, round(avg(g), 5) AS g, round(avg(b), 5) AS b, round(avg(CAST(r > 80 AND g > 40 AND b > 20 AND r > g AND r > b AND r - b > 20 AS INT)), 5) AS skin, round(avg(abs(l - m)), 12) AS detail FROM a GROUP BY frame, cell""")
def signature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = image.signature_cells(_pixels(spark, sf_dir), ["frame"])
    return got.withColumns({c: F.round(c, 12 if c == "detail" else 5) for c in ("r", "g", "b", "skin", "detail")})


@query("subtitle_mask", f"""
WITH {_pixels_sql(16)}, d AS (SELECT frame, x, y, CASE WHEN y = 13 AND x BETWEEN 3 AND frame % 13 + 2 THEN 255 ELSE r // 2 END AS r, CASE WHEN y = 13 AND x BETWEEN 3 AND frame % 13 + 2 THEN 255 ELSE g // 2 END AS g FROM p)
SELECT frame, count_if(y >= 12 AND r > 180 AND g > 180) BETWEEN 8 AND 16 AS has_subtitles FROM d GROUP BY frame""")
def subtitle_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (F.col("y") == 13) & F.col("x").between(3, F.col("frame") % 13 + 2)
    byte = lambda c: F.when(text, 255).otherwise(F.floor(c / 2).cast("int"))
    hexed = F.concat(*[F.lpad(F.hex(byte(F.col(c)).cast("long")), 2, "0") for c in "rgb"])
    rows = _pixels(spark, sf_dir).select("frame", "x", "y", hexed.alias("px"))
    whole = rows.groupBy("frame").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "px"))), lambda p: p["px"]), "")).alias("rgb"))
    sized = whole.withColumns({"w": F.lit(16), "h": F.lit(16)})
    return image.remove_subtitles(sized).select("frame", "has_subtitles")


@query("fingerprint_assembly", f"WITH {_HASHED} SELECT grid_id // 2 AS frame, CAST(count(*) AS INT) AS variants, max({_bits(256, 'x[i + 1] >= mean')}) AS top FROM bm GROUP BY grid_id // 2")
def fingerprint_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = pixels.hash_features(_grids(spark, sf_dir)).withColumn("frame", F.floor(F.col("grid_id") / 2)).withColumn("name", F.when(F.col("grid_id") % 2 == 0, "full").otherwise("zoom_2_0_center"))
    got = image.assemble(named, ["frame"])
    return got.select("frame", F.size("variants").alias("variants"), F.array_max(F.transform(F.map_values("variants"), lambda v: v["hash"])).alias("top"))


# Frames of 16x16 pixels, too dark for subtitles: each is its own grid.
_DARK = f"""{_pixels_sql(16)}, dk AS (SELECT frame, x, y, r // 2 AS r, g // 2 AS g, b FROM p),
mg AS (SELECT frame AS grid_id, list(0.299e0 * r + 0.587e0 * g + 0.114e0 * b ORDER BY y, x) AS gray FROM dk GROUP BY frame),
mm AS (SELECT *, list_sum(gray) / 256 AS mean FROM mg), fl AS (SELECT *, list_sum(list_transform(gray, lambda v: (v - mean) * (v - mean))) / 256 < 1 AS flat FROM mm),
b1 AS (SELECT grid_id, mean, flat, {_blur_sql("gray")} AS x1 FROM fl), b2 AS (SELECT grid_id, mean, flat, {_blur_sql("x1")} AS x2 FROM b1), b AS (SELECT grid_id, mean, flat, {_blur_sql("x2")} AS x FROM b2),
bm AS (SELECT *, list_transform(range(0, 256), lambda i: x[(i // 16) * 16 + 15 - i % 16 + 1]) AS y FROM b)"""


def _rgba(spark: SparkSession, sf_dir: str, side: int = 16) -> DataFrame:
    half = lambda c: F.floor(F.col(c) / 2).cast("long")
    dots = image.test_pixels(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("frame")), side, side)
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    rows = dots.select("frame", "x", "y", F.concat(byte(half("r")), byte(half("g")), byte(F.col("b").cast("long")), F.lit("FF")).alias("px"))
    whole = rows.groupBy("frame").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "px"))), lambda p: p["px"]), "")).alias("rgba"))
    return whole.select(F.lit("v").alias("video_id"), F.col("frame").cast("long").alias("si"), (F.col("frame") / F.lit(25.0)).alias("ts"), F.lit(side).alias("width"), F.lit(side).alias("height"), "rgba")


@query("rgba_frames", f"""
WITH {_DARK}, s AS (SELECT frame, list(round(v, 9) ORDER BY cell) AS detail FROM (SELECT frame, (y // 4) * 4 + x // 4 AS cell, avg(abs(l - m)) AS v FROM (SELECT *, avg(l) OVER (PARTITION BY frame, (y // 4) * 4 + x // 4) AS m FROM (SELECT *, 0.299e0 * r + 0.587e0 * g + 0.114e0 * b AS l FROM dk)) GROUP BY ALL) GROUP BY frame)
SELECT CAST(grid_id AS BIGINT) AS si, CAST(13 AS INT) AS variants, {_bits(256, 'x[i + 1] >= mean')} AS hash, {_dhash('x')} AS dhash, {_bits(256, 'y[i + 1] >= mean')} AS fhash, {_dhash('y')} AS fdhash, CAST(detail AS VARCHAR) AS detail FROM bm JOIN s ON s.frame = grid_id""")
def rgba_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in, packed variants and signature out."""
    got = pixels.fingerprints(_rgba(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(F.col("variants")[0][c], lambda w: F.reverse(F.lpad(F.bin(w), 32, "0"))), "")
    detail = F.concat(F.lit("["), F.array_join(F.transform("detail", lambda x: F.round(x, 9).cast("string")), ", "), F.lit("]"))
    return got.select("si", F.size("variants").alias("variants"), text("a").alias("hash"), text("d").alias("dhash"), text("fa").alias("fhash"), text("fd").alias("fdhash"), detail.alias("detail"))


@query("sanity_passes", "SELECT count(*) AS frames, CAST(0 AS BIGINT) AS differ FROM supplier")
def sanity_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over the pixels of test frames must agree."""
    return pixels.differing(_rgba(spark, sf_dir, 24))
