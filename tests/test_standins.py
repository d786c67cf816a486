"""What stands for videos in the queries that match."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliptrace.plans.match import with_cuts
from cliptrace.queries import QUERIES
from cliptrace.queries.base import SCENE, frames
from cliptrace.queries.scans import _shorts_and_movie


def test_matched_frames_have_all_grids_and_scenes(spark, sf_dir):
    """No step of a match (cuts by color, signature, motion, detail) is idle for want of grids."""
    short, movie = _shorts_and_movie(spark, sf_dir)
    n = frames(spark, sf_dir).count()
    for side in (short, movie):
        assert side.filter((F.size("color") == 48) & (F.size("skin") == 16) & (F.size("detail") == 16)).count() == n
    cut = with_cuts(movie.withColumn("video_id", F.lit("movie"))).orderBy("si").collect()
    assert [r["si"] for r in cut if r["is_cut"]] == list(range(SCENE, n, SCENE))
    assert all(6 < r["t_mag"] < 100 for r in cut if not r["is_cut"] and r["si"])
    cuts = {(r["video_id"], r["si"]) for r in with_cuts(short).filter("is_cut").collect()}
    assert cuts == {(k // 100, k % 100) for k in range(SCENE, n, SCENE) if k % 100}


def test_details_of_a_match_compare_grids(spark, sf_dir):
    got = QUERIES["match_details"](spark, sf_dir).collect()
    assert got and all(r[c] == 100 for r in got for c in ("structure_sim", "color_sim", "skin_sim", "detail_sim") if r["structure_sim"] == 100)
    assert any(r["structure_sim"] == 100 for r in got)
