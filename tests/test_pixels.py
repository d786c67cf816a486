"""Frames from raw pixels: against single operators, plain loops, odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cliptrace.functions import image, pixels
from cliptrace.functions.bits import pack_text

ROW = "video_id string, si long, ts double, width int, height int, rgba binary"


def raw(rng, w, h, high=150):
    rgb = rng.integers(0, high, (h, w, 3), np.uint8)
    return rgb, np.concatenate((rgb, np.full((h, w, 1), 255, np.uint8)), axis=2).tobytes()


def test_small_frames_equal_the_single_operators(spark):
    rng = np.random.default_rng(4)
    made = [raw(rng, 16, 16) for _ in range(12)] + [(np.full((16, 16, 3), 7, np.uint8), bytes([7, 7, 7, 255]) * 256)]
    got = {r["si"]: r for r in pixels.fingerprints(spark.createDataFrame([("v", k, k / 25, 16, 16, data) for k, (_, data) in enumerate(made)], ROW)).collect()}
    grays = [(k, (0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]).ravel().tolist()) for k, (rgb, _) in enumerate(made)]
    one = image.hash_features(spark.createDataFrame(grays, "si long, gray array<double>"))
    names = {"a": "hash", "d": "dhash", "fa": "fhash", "fd": "fdhash", "p": "phash"}
    for r in one.select("si", "flat", *[pack_text(F.col(c)).alias(k) for k, c in names.items()]).collect():
        full = got[r["si"]]["variants"][0]
        assert full["name"] == "full" and [list(full[c]) for c in names] == [list(r[c]) for c in names]
        assert r["flat"] == (r["si"] == 12)
    dots = [(k, x, y, *map(int, rgb[y, x])) for k, (rgb, _) in enumerate(made) for y in range(16) for x in range(16)]
    for r in image.signature_cells(spark.createDataFrame(dots, "si long, x int, y int, r int, g int, b int"), ["si"]).collect():
        f, c = got[r["si"]], r["cell"]
        assert np.allclose([*f["color"][3 * c : 3 * c + 3], f["skin"][c], f["detail"][c]], [r["r"], r["g"], r["b"], r["skin"], r["detail"]])


def test_area_means_equal_loops_over_parts_of_pixels():
    rng = np.random.default_rng(7)
    rgb = rng.integers(0, 256, (9, 13, 3)).astype(float)
    for rect in ((0, 0, 13, 9), (2, 1, 7, 6), (0.4, 1.3, 10.7, 6.1), (12, 8, 1, 1)):
        got = pixels.resampled(pixels.summed(rgb), rect, 4, 3)
        x, y, w, h = rect
        for i in range(3):
            for j in range(4):
                total, area = np.zeros(3), 0.0
                for py in range(9):
                    for px in range(13):
                        dy = min(py + 1, y + h * (i + 1) / 3) - max(py, y + h * i / 3)
                        dx = min(px + 1, x + w * (j + 1) / 4) - max(px, x + w * j / 4)
                        if dx > 0 and dy > 0:
                            total += rgb[py, px] * dx * dy
                            area += dx * dy
                assert np.abs(got[i, j] - total / area).max() <= 0.5 + 1e-6


def test_crops_subtitles_and_odd_rows(spark):
    rng = np.random.default_rng(9)
    plain, data = raw(rng, 160, 120)
    written = plain.copy()
    written[105:110, 40:90] = 230  # text in the lowest quarter
    text = np.concatenate((written, np.full((120, 160, 1), 255, np.uint8)), axis=2).tobytes()
    rows = [("v", 0, 0.0, 160, 120, data), ("v", 1, 0.04, 160, 120, text), ("v", 2, 0.08, 160, 120, data[:-4]), ("v", 3, 0.12, 160, 120, None), ("v", 4, 0.16, None, 120, data), ("w", 0, 0.0, 20, 300, raw(rng, 20, 300)[1]), ("v", 5, 0.2, 160, 120, data)]
    df = spark.createDataFrame(rows, ROW).withColumn("rects", F.lit("clash"))
    got = {(r["video_id"], r["si"]): r for r in pixels.fingerprints(df).collect()}
    assert len(got) == 7 and [got["v", k]["variants"] is None for k in range(6)] == [False, False, True, True, True, False]
    assert [v["name"] for v in got["v", 0]["variants"]] == image.CROPS == [v["name"] for v in got["w", 0]["variants"]]
    assert got["v", 0]["variants"] == got["v", 5]["variants"]
    assert len({tuple(v["a"]) for v in got["v", 0]["variants"]}) > 8 and len({tuple(v["a"]) for v in got["w", 0]["variants"][:6]}) == 1  # crops that do not fit are the whole frame
    found, cleaned = image._remove_subtitles(written, False)  # 120 rows high: the small image is the frame
    assert found
    want = pixels.hashes(pixels.luma(pixels.resampled(pixels.summed(cleaned), (0, 0, 160, 120), 16, 16))[None])
    assert list(got["v", 1]["variants"][0]["a"]) == want["a"][0].tolist() and got["v", 1]["variants"] != got["v", 0]["variants"]
    check = pixels.differing(df).first()
    assert (check["frames"], check["differ"]) == (7, 0)
    assert pixels.fingerprints(df.limit(0)).count() == 0
