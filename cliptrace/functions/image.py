"""Features of frames: crops, subtitle masking, perceptual hashes, signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import js_round

# The thirteen crops, in order.
CROPS = ["full", "crop_9_16_0", "crop_9_16_1", "crop_9_16_2", "crop_9_16_3", "crop_9_16_4", "zoom_1_25_center", "zoom_1_25_left", "zoom_1_25_right", "zoom_1_5_center", "zoom_1_5_left", "zoom_1_5_right", "zoom_2_0_center"]
SIDE = 16


def even_down(x: Column) -> Column:
    """The next even number at or below ``x``."""
    return x - F.pmod(x, F.lit(2))


def _between(x: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, x))


def crop_rects(frames: DataFrame, width: str = "w", height: str = "h") -> DataFrame:
    """Thirteen rows (crop_idx, name, sx, sy, sw, sh) for each row."""
    w, h, zero, one = F.col(width).cast("long"), F.col(height).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")
    rect = lambda name, sx, sy, sw, sh: F.struct(F.lit(name).alias("name"), sx.alias("sx"), sy.alias("sy"), sw.alias("sw"), sh.alias("sh"))
    rects = [rect("full", zero, zero, w, h)]
    crop = even_down(js_round(h * F.lit(9.0) / 16))
    fits = crop <= w
    for i in range(5):
        sx = even_down(js_round((w - crop) / F.lit(4.0) * i))
        rects.append(rect(f"crop_9_16_{i}", F.when(fits, sx).otherwise(zero), zero, F.when(fits, crop).otherwise(w), h))
    for name, zoom, places in (("zoom_1_25", 1.25, ("center", "left", "right")), ("zoom_1_5", 1.5, ("center", "left", "right")), ("zoom_2_0", 2.0, ("center",))):
        sw, sh = (even_down(_between(js_round(x / F.lit(zoom)), one, x)) for x in (w, h))
        sy = even_down(_between(js_round((h - sh) / F.lit(2.0)), zero, h - sh))
        at = {"center": even_down(_between(js_round((w - sw) / F.lit(2.0)), zero, w - sw)), "left": zero, "right": even_down(F.greatest(w - sw, zero))}
        rects += [rect(f"{name}_{p}", at[p], sy, sw, sh) for p in places]
    return frames.select("*", F.posexplode(F.array(*rects)).alias("crop_idx", "_r")).select("*", "_r.*").drop("_r")


def crop_label(name: Column) -> Column:
    """A reader's name of a crop; unknown names stay."""
    part = lambda k: F.get(F.split(name, "_"), F.lit(k))
    zoom = F.concat(F.lit("Zoom "), part(1), F.lit("."), part(2), F.lit("x "), F.initcap(part(3)))
    return (
        F.when(name == "full", F.lit("Full Frame"))
        .when(name.isin([c for c in CROPS if c.startswith("zoom")]), zoom)
        .when(name.startswith("crop_9_16_"), F.concat(F.lit("9:16 Crop "), (part(3).try_cast("int") + 1).cast("string")))
        .otherwise(name)
    )


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma of a pixel."""
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def is_flat(grays: Column) -> Column:
    """Population variance below 1."""
    n = F.size(grays)
    mean = F.aggregate(grays, F.lit(0.0), lambda acc, x: acc + x) / n
    return F.aggregate(grays, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n < 1.0


def blur(grays: Column, side: int = SIDE) -> Column:
    """Mean over the 3x3 neighbours that lie inside."""
    def cell(i: Column) -> Column:
        row, col = F.floor(i / side).cast("int"), i % side
        terms, count = F.lit(0.0), F.lit(0)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                ok = (row + dy >= 0) & (row + dy < side) & (col + dx >= 0) & (col + dx < side)
                terms = terms + F.when(ok, F.get(grays, ((row + dy) * side + col + dx).cast("int"))).otherwise(0.0)
                count = count + ok.cast("int")
        return terms / count

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), cell)


def _text(bits: Column) -> Column:
    return F.array_join(F.transform(bits, lambda x: x.cast("int").cast("string")), "")


def ahash_bits(grid: Column, threshold: Column) -> Column:
    """'0' and '1': cells at or above the threshold."""
    return _text(F.transform(grid, lambda x: x >= threshold))


def dhash_bits(grid: Column, side: int = SIDE) -> Column:
    """'0' and '1': cells below their right neighbour, then below the next row's."""
    at = lambda i: F.get(grid, i.cast("int"))
    across = F.transform(F.sequence(F.lit(0), F.lit(side * (side - 1) - 1)), lambda i: at(F.floor(i / (side - 1)) * side + i % (side - 1) + 1) > at(F.floor(i / (side - 1)) * side + i % (side - 1)))
    down = F.transform(F.sequence(F.lit(0), F.lit(side * (side - 1) - 1)), lambda i: at(i + side) > at(i))
    return F.concat(_text(across), _text(down))


def mirror(grid: Column, side: int = SIDE) -> Column:
    """A square grid with its columns in reverse."""
    return F.transform(grid, lambda _, i: F.get(grid, (F.floor(i / side) * side + side - 1 - i % side).cast("int")))


def phash_matrix(side: int = SIDE, keep: int = 8) -> np.ndarray:
    """Rows of the unnormalized cosine transform that are kept."""
    k, x = np.arange(keep)[:, None], np.arange(side)[None, :]
    return np.cos((2 * x + 1) * k * np.pi / (2 * side))


@F.pandas_udf(T.StringType())
def phash_bits(grid: pd.Series) -> pd.Series:
    """'0' and '1': kept coefficients above the median of all but the first."""
    if not len(grid):
        return pd.Series([], dtype=object)
    c = phash_matrix()
    g = np.stack(grid.to_numpy()).astype(float).reshape(-1, SIDE, SIDE)
    coef = np.einsum("ky,nyx,lx->nkl", c, g, c).reshape(len(g), -1)
    median = np.sort(coef[:, 1:], axis=1)[:, 31]
    return pd.Series(["".join("1" if b else "0" for b in row) for row in coef > median[:, None]])


def hash_features(frames: DataFrame, gray_col: str = "gray") -> DataFrame:
    """Add ``flat``, ``hash``, ``dhash``, ``fhash``, ``fdhash`` and ``phash``
    of 16x16 gray grids; flat frames have zeros only."""
    g = F.col(gray_col)
    smooth = frames.withColumn("_mean", F.aggregate(g, F.lit(0.0), lambda acc, x: acc + x) / F.size(g)).withColumn("flat", is_flat(g))
    smooth = smooth.withColumn("_b1", blur(g)).withColumn("_b2", blur(F.col("_b1"))).withColumn("_b", blur(F.col("_b2"))).withColumn("_m", mirror(F.col("_b")))
    zero = lambda n: F.lit("0" * n)
    pick = lambda bits, n: F.when(F.col("flat"), zero(n)).otherwise(bits)
    return smooth.withColumns({
        "hash": pick(ahash_bits(F.col("_b"), F.col("_mean")), 256), "dhash": pick(dhash_bits(F.col("_b")), 480),
        "fhash": pick(ahash_bits(F.col("_m"), F.col("_mean")), 256), "fdhash": pick(dhash_bits(F.col("_m")), 480),
        "phash": pick(phash_bits(F.col("_b")), 64),
    }).drop("_mean", "_b1", "_b2", "_b", "_m")


def is_skin(r: Column, g: Column, b: Column) -> Column:
    """A simple skin-tone rule."""
    return (r > 80) & (g > 40) & (b > 20) & (r > g) & (r > b) & (r - b > 20)


def signature_cells(pixels: DataFrame, key: list[str], side: int = SIDE) -> DataFrame:
    """Per frame and 4x4 cell: mean color, share of skin, mean absolute
    deviation of gray.  ``pixels`` has (key..., x, y, r, g, b)."""
    size = max(1, side // 4)
    inside = pixels.filter((F.col("x") < 4 * size) & (F.col("y") < 4 * size))
    cell = (F.floor(F.col("y") / size) * 4 + F.floor(F.col("x") / size)).cast("int")
    luma = gray(F.col("r"), F.col("g"), F.col("b"))
    got = inside.groupBy(*key, cell.alias("cell")).agg(
        F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"),
        F.avg(is_skin(F.col("r"), F.col("g"), F.col("b")).cast("double")).alias("skin"), F.collect_list(luma).alias("_gray"),
    )
    mean = F.aggregate("_gray", F.lit(0.0), lambda acc, x: acc + x) / F.size("_gray")
    return got.withColumn("detail", F.aggregate("_gray", F.lit(0.0), lambda acc, x: acc + F.abs(x - mean)) / F.size("_gray")).drop("_gray")


def _remove_subtitles(rgb: np.ndarray, force: bool) -> tuple[bool, np.ndarray]:
    h, w, _ = rgb.shape
    low = int(h * 0.75)
    mask = np.zeros((h, w), bool)
    mask[low:] = (rgb[low:, :, 0] > 180) & (rgb[low:, :, 1] > 180)
    n = int(mask.sum())
    found = 8 <= n <= w * (h - low) * 0.25
    if not found and not force:
        return False, rgb
    grown = np.zeros((h + 4, w + 4), bool)
    for dy in range(5):
        for dx in range(5):
            grown[dy : dy + h, dx : dx + w] |= mask
    grown = grown[2 : h + 2, 2 : w + 2]
    rows = np.where(grown, -1, np.arange(h)[:, None])
    source = np.maximum.accumulate(rows, axis=0)  # the nearest kept row above
    fill = grown & (source >= 0)
    out = rgb.copy()
    y, x = np.nonzero(fill)
    out[y, x] = rgb[source[y, x], x]
    return True, out


def remove_subtitles(frames: DataFrame, rgb: str = "rgb", width: str = "w", height: str = "h", force: bool = False) -> DataFrame:
    """Add ``has_subtitles`` and ``cleaned``: bright text in the lowest quarter,
    grown by two pixels, is filled from the nearest kept pixel above.

    ``rgb`` holds bytes r, g, b of each pixel by rows.
    """
    kind = T.StructType([T.StructField("has_subtitles", T.BooleanType()), T.StructField("cleaned", T.BinaryType())])

    @F.pandas_udf(kind)
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, w, h in batches:
            out = [_remove_subtitles(np.frombuffer(d, np.uint8).reshape(int(b), int(a), 3), force) for d, a, b in zip(data, w, h, strict=True)]
            yield pd.DataFrame({"has_subtitles": [x for x, _ in out], "cleaned": [y.tobytes() for _, y in out]})

    return frames.withColumn("_s", of(rgb, width, height)).select("*", "_s.*").drop("_s")


def test_pixels(frames: DataFrame, width: int, height: int, frame: str = "frame") -> DataFrame:
    """Pixels (x, y, r, g, b) of a synthetic pattern for each frame number."""
    f, x, y = F.col(frame), F.col("x"), F.col("y")
    wide = frames.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    low = lambda c: c.bitwiseAND(F.lit(255))
    return wide.withColumns({
        "r": low((x * (f + 1) * 31 + y * 97).bitwiseXOR(f * 53)),
        "g": low((y * (f + 1) * 67 + x * 41).bitwiseXOR(f * 29)),
        "b": low((x * y * 7 + f * 113).bitwiseXOR(F.lit(128))),
    })


def assemble(hashed: DataFrame, key: list[str], name: str = "name") -> DataFrame:
    """One row a frame: a map from variant to its hashes."""
    hashes = F.struct("hash", "dhash", "fhash", "fdhash", "phash")
    return hashed.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), hashes.alias("value"))))).alias("variants"))
