"""Frames from raw pixels: thirteen crops, their hashes and the signature.

One pass over Arrow batches: a summed-area table of a frame gives the mean of any
rectangle, edges inside pixels included, from four places, so that all crops and
the small image for subtitles cost about one pass over the pixels.  The 16x16
grids of all crops of a batch are then hashed together.

A resampler is a choice: this one takes area means, rounded to bytes.  Frames of
16x16 pixels are their own grid, with the features that ``functions.image`` gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .image import CROPS, SIDE, _remove_subtitles, crop_rects, phash_matrix

#: Height of the image in which subtitles are looked for.
SMALL = 120
#: Crops of frames that are hashed together.
GRIDS_AT_ONCE = 13 * 256
FEATURES = (
    "video_id string, si long, ts double, variants array<struct<name: string, a: array<bigint>, d: array<bigint>, fa: array<bigint>, fd: array<bigint>, p: array<bigint>>>, "
    "color array<double>, skin array<double>, detail array<double>"
)


def summed(rgb: np.ndarray) -> np.ndarray:
    """Sums of all pixels above and left of each corner."""
    out = np.zeros((rgb.shape[0] + 1, rgb.shape[1] + 1, 3))
    np.cumsum(np.cumsum(rgb, axis=0, dtype=float), axis=1, out=out[1:, 1:])
    return out


def _along(table: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
    """Values between corners, of which sums are linear within a pixel."""
    low = np.minimum(np.floor(at).astype(int), table.shape[axis] - 2)
    share = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
    return np.take(table, low, axis) * (1 - share) + np.take(table, low + 1, axis) * share


def resampled(table: np.ndarray, rect: tuple[float, float, float, float], width: int, height: int) -> np.ndarray:
    """Means of the cells of a rectangle (x, y, w, h), rounded half up."""
    x, y, w, h = rect
    xs = np.clip(x + w * np.arange(width + 1) / width, 0, table.shape[1] - 1)
    ys = np.clip(y + h * np.arange(height + 1) / height, 0, table.shape[0] - 1)
    v = _along(_along(table, ys, 0), xs, 1)
    cells = v[1:, 1:] - v[:-1, 1:] - v[1:, :-1] + v[:-1, :-1]
    area = np.maximum(np.diff(ys)[:, None] * np.diff(xs)[None, :], 1e-12)
    return np.clip(np.floor(cells / area[:, :, None] + 0.5), 0, 255)


def crop_grids(rgb: np.ndarray, rects: list[tuple[float, float, float, float]]) -> np.ndarray:
    """16x16 colors of each crop of a frame; where there are subtitles, of the
    small image without them."""
    h, w = rgb.shape[:2]
    table = summed(rgb)
    small_w = max(1, int(np.floor(w * SMALL / h + 0.5)))
    found, cleaned = _remove_subtitles(resampled(table, (0, 0, w, h), small_w, SMALL).astype(np.uint8), False)
    if not found:
        return np.stack([resampled(table, r, SIDE, SIDE) for r in rects])
    fx, fy, table = small_w / w, SMALL / h, summed(cleaned)
    return np.stack([resampled(table, (r[0] * fx, r[1] * fy, r[2] * fx, r[3] * fy), SIDE, SIDE) for r in rects])


def luma(colors: np.ndarray) -> np.ndarray:
    """Gray of colors."""
    return 0.299 * colors[..., 0] + 0.587 * colors[..., 1] + 0.114 * colors[..., 2]


def blurred(grays: np.ndarray) -> np.ndarray:
    """Mean over the neighbours that lie inside."""
    wide = np.pad(grays, ((0, 0), (1, 1), (1, 1)))
    ones = np.pad(np.ones((1, SIDE, SIDE)), ((0, 0), (1, 1), (1, 1)))
    add = lambda g: sum(g[:, y : y + SIDE, x : x + SIDE] for y in range(3) for x in range(3))
    return add(wide) / add(ones)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row, 32 in a word, the first one lowest."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint32).astype(np.int64)


def hash_bits(grays: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which gray grids are flat, and the bits of their hashes; of flat ones
    all zeros."""
    n = len(grays)
    flat = grays.reshape(n, -1).var(axis=1) < 1.0
    mean = grays.reshape(n, -1).mean(axis=1)[:, None, None]
    smooth = blurred(blurred(blurred(grays)))
    turned = smooth[:, :, ::-1]
    steps = lambda g: np.concatenate(((g[:, :, 1:] > g[:, :, :-1]).reshape(n, -1), (g[:, 1:] > g[:, :-1]).reshape(n, -1)), axis=1)
    c = phash_matrix()
    coef = np.einsum("ky,nyx,lx->nkl", c, smooth, c).reshape(n, -1)
    bits = {"a": (smooth >= mean).reshape(n, -1), "d": steps(smooth), "fa": (turned >= mean).reshape(n, -1), "fd": steps(turned), "p": coef > np.sort(coef[:, 1:], axis=1)[:, 31:32]}
    return flat, {k: b & ~flat[:, None] for k, b in bits.items()}


def hashes(grays: np.ndarray) -> dict[str, np.ndarray]:
    """Packed hashes of gray grids."""
    return {k: _words(b) for k, b in hash_bits(grays)[1].items()}


_TEXTS = {"hash": "a", "dhash": "d", "fhash": "fa", "fdhash": "fd", "phash": "p"}


def hash_features(frames: DataFrame, gray: str = "gray") -> DataFrame:
    """Add ``flat``, ``hash``, ``dhash``, ``fhash``, ``fdhash`` and ``phash``
    (as texts of 0 and 1) of 16x16 gray grids; flat frames have zeros only."""
    kind = T.StructType([T.StructField("flat", T.BooleanType()), *[T.StructField(c, T.StringType()) for c in _TEXTS]])

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat, bits = hash_bits(np.stack(batch.to_numpy()).astype(float).reshape(-1, SIDE, SIDE)) if len(batch) else (np.zeros(0, bool), {k: np.zeros((0, 32), bool) for k in _TEXTS.values()})
            texts = {c: [(row + 48).astype(np.uint8).tobytes().decode() for row in bits[k].astype(np.uint8)] for c, k in _TEXTS.items()}
            yield pd.DataFrame({"flat": flat, **texts}).astype({c: object for c in _TEXTS})

    return frames.withColumn("_hashed", of(gray)).select("*", "_hashed.*").drop("_hashed")


def signatures(colors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Color, skin and detail of the 4x4 cells of each 16x16 grid."""
    n = len(colors)
    cells = colors.reshape(n, 4, 4, 4, 4, 3).transpose(0, 1, 3, 2, 4, 5).reshape(n, 16, 16, 3)
    r, g, b = cells[..., 0], cells[..., 1], cells[..., 2]
    skin = (r > 80) & (g > 40) & (b > 20) & (r > g) & (r > b) & (r - b > 20)
    gray = luma(cells)
    return cells.mean(axis=2).reshape(n, 48), skin.mean(axis=2), np.abs(gray - gray.mean(axis=2, keepdims=True)).mean(axis=2)


def fingerprints(frames: DataFrame) -> DataFrame:
    """Frames (video_id, si, ts, variants, color, skin, detail) from pixels
    (video_id, si, ts, width, height, rgba), bytes r, g, b, a by rows.

    A frame whose bytes do not fit its size, or that has none, has null features.
    An Arrow batch is held at once: for large frames set
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` so that it fits.
    """
    frames = frames.select("video_id", "si", "ts", "width", "height", "rgba")
    sized = crop_rects(frames.select("width", "height").distinct(), "width", "height")
    rects = sized.groupBy("width", "height").agg(F.array_sort(F.collect_list(F.struct("crop_idx", "sx", "sy", "sw", "sh"))).alias("rects"))
    rows = frames.join(rects, ["width", "height"], "left")  # a row for each size of frame

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, GRIDS_AT_ONCE // len(CROPS)):
                yield _features(batch.slice(lo, GRIDS_AT_ONCE // len(CROPS)))

    return rows.mapInArrow(run, FEATURES)


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    grids: list[np.ndarray] = []
    good: list[int] = []
    for k in range(batch.num_rows):
        w, h, data = batch["width"][k].as_py(), batch["height"][k].as_py(), batch["rgba"][k]
        if not data.is_valid or not w or not h or len(data.as_buffer()) != w * h * 4:
            continue
        rgb = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, 4)[:, :, :3]
        grids.append(crop_grids(rgb, [(r["sx"], r["sy"], r["sw"], r["sh"]) for r in batch["rects"][k].as_py()]))
        good.append(k)
    out: dict[str, list] = {c: [None] * batch.num_rows for c in ("variants", "color", "skin", "detail")}
    if good:
        colors = np.stack(grids)
        packed = {c: x.reshape(len(good), len(CROPS), -1).tolist() for c, x in hashes(luma(colors).reshape(-1, SIDE, SIDE)).items()}
        marks = signatures(colors[:, 0])
        for i, k in enumerate(good):
            out["variants"][k] = [{"name": name, **{c: packed[c][i][v] for c in ("a", "d", "fa", "fd", "p")}} for v, name in enumerate(CROPS)]
            for c, x in zip(("color", "skin", "detail"), marks, strict=True):
                out[c][k] = x[i].tolist()
    words = pa.list_(pa.int64())
    kinds = {"variants": pa.list_(pa.struct([("name", pa.string()), *[(c, words) for c in ("a", "d", "fa", "fd", "p")]])), **{c: pa.list_(pa.float64()) for c in ("color", "skin", "detail")}}
    made = [pa.array(out[c], kinds[c]) for c in kinds]
    return pa.RecordBatch.from_arrays([batch["video_id"].cast(pa.string()), batch["si"].cast(pa.int64()), batch["ts"].cast(pa.float64()), *made], names=["video_id", "si", "ts", *kinds])


def differing(frames: DataFrame) -> DataFrame:
    """(frames, differ): frames whose features are not the same in two passes
    over their pixels, dealt out in another way."""
    digest = lambda df, name: df.select("video_id", "si", F.xxhash64("variants", "color", "skin", "detail").alias(name))
    one, two = digest(fingerprints(frames), "_one"), digest(fingerprints(frames.repartition("si")), "_two")
    both = one.join(two, ["video_id", "si"], "full")
    return both.agg(F.count("*").alias("frames"), F.count_if(~F.col("_one").eqNullSafe(F.col("_two"))).alias("differ"))
