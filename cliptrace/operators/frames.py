"""Series of frames: motion, scene cuts, chunks, seeds, gaps, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.bits import bit_sim, js_round
from ..functions.similarity import dot, total

# Similarities (0 to 100) below which, and color motion above
# which, a frame begins a scene.
CUT_AHASH, CUT_DHASH, CUT_MOTION = 25.0, 28.0, 100.0
# Fixed value: movie frames that forced matches of one group may stray.
FORCED_REACH = 50


def in_order(key: str, order: str) -> WindowSpec:
    """The rows of a key up to the present one."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def motion(frames: DataFrame, color: str = "color", key: str = "video_id", order: str = "si") -> DataFrame:
    """Add ``t_delta`` and ``t_mag``: the change of the color grid since the
    frame before, and its length; null on the first frame, and everywhere in a
    video of which any frame has no full grid."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(color).over(w)
    whole = F.min((F.coalesce(F.size(color), F.lit(0)) == 48).cast("int")).over(Window.partitionBy(key)) == 1
    delta = F.when(whole & before.isNotNull(), F.zip_with(color, before, lambda x, y: x.cast("double") - y.cast("double")))
    return frames.withColumn("t_delta", delta).withColumn("t_mag", F.sqrt(dot(F.col("t_delta"), F.col("t_delta"))))


def scene_cuts(frames: DataFrame, key: str = "video_id", order: str = "si") -> DataFrame:
    """Add ``is_cut``: hashes of the whole frame (``a``, ``d``) far from those
    of the frame before, or much color motion."""
    w = Window.partitionBy(key).orderBy(order)
    a, d = (bit_sim(F.lag(c).over(w), F.col(c)) * 100 for c in ("a", "d"))
    over = [F.coalesce(x, F.lit(False)) for x in (a < CUT_AHASH, d < CUT_DHASH, F.col("t_mag") > CUT_MOTION)]
    return frames.withColumn("is_cut", over[0] | over[1] | over[2])


def scene_chunks(frames: DataFrame, key: str = "video_id", order: str = "si", cut: str = "is_cut") -> DataFrame:
    """(key, chunk_id, start, end): runs of frames between cuts."""
    w = in_order(key, order)
    numbered = frames.withColumn("chunk_id", F.sum(F.col(cut).cast("int")).over(w))
    return numbered.groupBy(key, "chunk_id").agg(F.min(order).alias("start"), F.max(order).alias("end"))


def seeds(start: Column, end: Column, dense: bool = False) -> Column:
    """Positions in a chunk that are scanned for: five quantiles, and if
    ``dense`` every 25th part (at least 10 frames apart)."""
    size = end - start + 1
    places = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda p: (start + js_round(p * (size - 1) / F.lit(4.0))).cast("long"))
    if dense:
        step = F.greatest(F.lit(10), F.ceil(size / F.lit(25.0)).cast("int")).cast("long")
        places = F.concat(places, F.sequence(start.cast("long"), end.cast("long"), step))
    return F.array_distinct(places)


def seed_positions(chunks: DataFrame, dense: bool = False) -> DataFrame:
    """One row for each seed of each chunk."""
    return chunks.withColumn("si", F.explode(seeds(F.col("start"), F.col("end"), dense)))


def fill_gaps(points: DataFrame, key: str = "seq_id", longest: int = 3) -> DataFrame:
    """(key, si, mi, sim): sequences with steps of 2 or 3 short frames filled,
    ``mi`` along the line, ``sim`` as the mean of both ends."""
    w = Window.partitionBy(key).orderBy("si")
    ahead = points.select(key, "si", "mi", "sim", *[F.lead(c).over(w).alias(f"_{c}") for c in ("si", "mi", "sim")])
    step = F.col("_si") - F.col("si")
    more = F.when(step.between(2, longest), F.sequence(F.lit(0).cast("long"), step - 1)).otherwise(F.array(F.lit(0).cast("long")))
    rows = ahead.withColumn("_k", F.explode(more)).withColumn("_step", step)
    mi = F.when(F.col("_k") == 0, F.col("mi")).otherwise(js_round(F.col("mi") + F.col("_k") / F.col("_step") * (F.col("_mi") - F.col("mi"))))
    sim = F.when(F.col("_k") == 0, F.col("sim")).otherwise((F.col("sim") + F.col("_sim")) / 2)
    return rows.select(key, (F.col("si") + F.col("_k")).alias("si"), mi.cast("long").alias("mi"), sim.alias("sim"))


def regression_slope(points: DataFrame, key: str, x: str = "si", y: str = "mi") -> DataFrame:
    """(key, slope): least-squares slope, 1 without two distinct points,
    clamped to 0.1 .. 8."""
    raw = F.when(F.count("*") >= 2, F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")))
    return points.groupBy(key).agg(F.least(F.lit(8.0), F.greatest(F.lit(0.1), F.coalesce(raw, F.lit(1.0)))).alias("slope"))


def frame_duration(frames: DataFrame, key: str = "video_id", ts: str = "ts", order: str = "si", first: int = 200) -> DataFrame:
    """(key, duration): upper median of the positive ones of the ``first``
    steps of time, frames taken in ``order``; keys without any have no row."""
    w = Window.partitionBy(key).orderBy(order)
    # Spark keeps the first rows of each window while it ranks them.
    some = frames.select(key, order, ts).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first + 1)
    steps = some.select(key, (F.col(ts) - F.lag(ts).over(w)).alias("step")).filter("step > 0")
    got = steps.groupBy(key).agg(F.array_sort(F.collect_list("step")).alias("_s"))
    return got.select(key, F.get("_s", F.floor(F.size("_s") / 2).cast("int")).alias("duration"))


def forced_groups(points: DataFrame, key: str = "seq_id", reach: int = FORCED_REACH) -> DataFrame:
    """Add ``grp``: frames in order go on in one group while the movie frame
    stays within ``reach`` of where the frame before leads."""
    w = Window.partitionBy(key).orderBy("si")
    expected = F.lag("mi").over(w) + F.col("si") - F.lag("si").over(w)
    near = F.coalesce(F.abs(F.col("mi") - expected) <= reach, F.lit(False))
    return points.withColumn("_f", F.when(near, 0).otherwise(1)).withColumn("grp", F.sum("_f").over(w)).drop("_f")


def rolling_mean(rows: DataFrame, value: str, key: str, order: list[str], last: int = 50) -> DataFrame:
    """Add ``rolling``: the mean of the last ``last`` values, this one included."""
    return rows.withColumn("rolling", F.avg(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)))


def mean_variant_sim(sims: Column) -> Column:
    """Mean of an array of similarities."""
    return total(sims) / F.size(sims)
