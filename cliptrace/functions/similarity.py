"""Similarities of frames: hashes, signatures, motion, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import bit_sim

# Weights of the channels of a hash comparison.
W_ADP = (0.25, 0.35, 0.40)
W_AD = (0.55, 0.45)
W_AP = (0.5, 0.5)
# Weights of hash, signature and motion in a frame comparison.
W_FRAME = (0.70, 0.14, 0.16)
W_FRAME_STILL = (0.84, 0.16)
# Color change below which a frame is still, and its scores.
STILL, BOTH_STILL, ONE_STILL = 6.0, 78.0, 38.0


def total(xs: Column) -> Column:
    """Sum of an array of doubles, from the left."""
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def l2_normalize(a: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def pair_sim(s: dict[str, Column], m: dict[str, Column]) -> Column:
    """Similarity (0 to 100) of a short variant ``s`` (a, d, p) and a movie
    variant ``m`` (a, d, p, fa, fd); the mirrored movie counts too."""
    a, d, p = bit_sim(s["a"], m["a"]), bit_sim(s["d"], m["d"]), bit_sim(s["p"], m["p"])
    normal = (
        F.when(d.isNotNull() & p.isNotNull(), W_ADP[0] * a + W_ADP[1] * d + W_ADP[2] * p)
        .when(d.isNotNull(), W_AD[0] * a + W_AD[1] * d)
        .when(p.isNotNull(), W_AP[0] * a + W_AP[1] * p)
        .otherwise(a)
    )
    fa, fd = bit_sim(s["a"], m["fa"]), bit_sim(s["d"], m["fd"])
    flipped = F.when(fa.isNotNull() & fd.isNotNull(), W_AD[0] * fa + W_AD[1] * fd).otherwise(fa)
    return F.greatest(F.coalesce(normal, F.lit(0.0)), F.coalesce(flipped, F.lit(0.0))) * 100


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: lambdas compute what they
    capture again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def color_znorm(grid: Column) -> Column:
    """Each channel of a 4x4x3 grid as z-scores, with deviations of 8 at least."""
    cells = F.sequence(F.lit(0), F.lit(15))

    def mean(g: Column, c: int) -> Column:
        return total(F.transform(cells, lambda i: F.get(g, i * 3 + c).cast("double"))) / 16

    def sd(g: Column, m: Column, c: int) -> Column:
        square = lambda i: (F.get(g, i * 3 + c).cast("double") - F.get(m, F.lit(c))) * (F.get(g, i * 3 + c).cast("double") - F.get(m, F.lit(c)))
        return F.greatest(F.sqrt(total(F.transform(cells, square)) / 16), F.lit(8.0))

    scaled = lambda g, m, s: F.transform(g, lambda x, i: (x.cast("double") - F.get(m, i % 3)) / F.get(s, i % 3))
    return let(grid, lambda g: let(F.array(*[mean(g, c) for c in range(3)]), lambda m: let(F.array(*[sd(g, m, c) for c in range(3)]), lambda s: scaled(g, m, s))))


def _abs_diff(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def mirror_grid(grid: Column, channels: int) -> Column:
    """A 4x4 grid with its columns in reverse."""
    def source(i: Column) -> Column:
        cell, k = F.floor(i / channels).cast("int"), i % channels
        row, col = F.floor(cell / 4).cast("int"), cell % 4
        return ((row * 4 + 3 - col) * channels + k).cast("int")

    return F.transform(grid, lambda _, i: F.get(grid, source(i)))


def with_signature(frames: DataFrame) -> DataFrame:
    """Add what comparisons of signatures need: z-scores of the color grid
    (``z``, null unless it has 48 values) and all grids mirrored (``t_...``)."""
    z = frames.withColumn("z", F.when(F.size("color") == 48, color_znorm(F.col("color"))))
    return z.withColumns({"t_z": mirror_grid(F.col("z"), 3), "t_skin": mirror_grid(F.col("skin"), 1), "t_detail": mirror_grid(F.col("detail"), 1)})


def grid_sims(s: dict[str, Column], m: dict[str, Column], turned: bool = False) -> tuple[Column, Column, Column]:
    """Color, skin and detail similarity (about 0 to 1; null: not available)
    of rows of ``with_signature``; ``turned``: to the mirrored movie."""
    both = lambda x, y: x.isNotNull() & y.isNotNull() & (F.size(x) > 0) & (F.size(x) == F.size(y))
    lead = "t_" if turned else ""
    z, skins, details = m[f"{lead}z"], m[f"{lead}skin"], m[f"{lead}detail"]
    color = F.when(both(s["z"], z), F.greatest(F.lit(0.0), 1 - _abs_diff(s["z"], z) / 48 / 2)).when(
        both(s["color"], m["color"]), 1 - _abs_diff(s["color"], m["color"]) / (F.size(s["color"]) * 255)
    )
    skin = F.when(both(s["skin"], skins), 1 - _abs_diff(s["skin"], skins) / F.size(s["skin"]))
    top = F.greatest(F.lit(1.0), F.array_max(s["detail"]).cast("double"), F.array_max(details).cast("double"))
    detail = F.when(both(s["detail"], details), 1 - _abs_diff(s["detail"], details) / top / F.size(s["detail"]))
    return color, skin, detail


def signature_sim(s: dict[str, Column], m: dict[str, Column]) -> Column:
    """Mean of the available grid similarities (0 to 100), the better of the
    movie's grids as they are and mirrored; 50 without any."""
    def mean(turned: bool) -> Column:
        def of(parts: Column) -> Column:
            have = F.filter(parts, lambda x: x.isNotNull())
            return F.when(F.size(have) > 0, total(have) / F.size(have) * 100).otherwise(F.lit(50.0))

        return let(F.array(*grid_sims(s, m, turned)), of)

    return F.when(m["z"].isNotNull(), F.greatest(mean(False), mean(True))).otherwise(mean(False))


def temporal_sim(s_delta: Column, s_mag: Column, m_delta: Column, m_mag: Column) -> Column:
    """Similarity of color motion (0 to 100); -1 where a side has none."""
    still = F.when((s_mag < STILL) & (m_mag < STILL), F.lit(BOTH_STILL)).when((s_mag < STILL) | (m_mag < STILL), F.lit(ONE_STILL))
    moving = (dot(s_delta, m_delta) / (s_mag * m_mag) + 1) / 2 * 100
    none = s_delta.isNull() | m_delta.isNull() | s_mag.isNull() | m_mag.isNull()
    return F.when(none, F.lit(-1.0)).otherwise(F.coalesce(still, moving))


def frame_sim(hash_sim: Column, sig_sim: Column, time_sim: Column) -> Column:
    """Weighted similarity; a null signature leaves the hashes alone."""
    return (
        F.when(sig_sim.isNull(), hash_sim)
        .when(time_sim >= 0, W_FRAME[0] * hash_sim + W_FRAME[1] * sig_sim + W_FRAME[2] * time_sim)
        .otherwise(W_FRAME_STILL[0] * hash_sim + W_FRAME_STILL[1] * sig_sim)
    )
