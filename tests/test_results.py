"""Result files that read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cliptrace.plans import match as plan
from cliptrace.sources import fingerprints as fp

from .test_matching import clip  # noqa: F401  a fixture

DETAIL = {"cropRegion": "full", "structureSim": 91.5, "colorSim": 80.0, "skinSim": 99.0, "detailSim": 50.0, "movieHash": "", "shortHash": "0101"}
SEGMENT = {"shortStart": 0.0, "shortEnd": 1.5, "movieStart": 10.0, "movieEnd": 11.5, "confidence": 93.25, "frameCount": 37, "isApproximate": False, "gapCount": 1, "speedRatio": 1.0, "matchSequence": [{"shortTime": 0.0, "movieTime": 10.0, "similarity": 95.0}], "bestFrameDetail": DETAIL}
STATS = {"accepted": 4, "rejected": 2, "inconclusiveNetwork": 1, "otherUnverifiable": 0, "recoveredByDeferred": 1, "stillUnmatchedAfterDeferred": 0}


def test_files_read_back(spark, tmp_path):
    whole = {"segments": [SEGMENT, {**SEGMENT, "shortStart": 2.0, "bestFrameDetail": None}], "unmatchedRanges": [{"shortStart": 1.5, "shortEnd": 2.0}], "movieFrames": 1007, "shortFrames": 450, "vlmStats": STATS}
    bare = {"segments": [], "unmatchedRanges": [], "movieFrames": 3, "shortFrames": 2}
    (tmp_path / "match-1 a_matchresult.json").write_text(json.dumps(whole))
    (tmp_path / "m=2_matchresult.json").write_text(json.dumps(bare, indent=1))
    read = fp.read_matches(spark, str(tmp_path / "*_matchresult.json"))
    rows = {r["match_id"]: r.asDict(True) for r in read.collect()}
    first = rows["match-1 a"]
    assert first["segments"] == whole["segments"] and first["vlmStats"] == STATS and first["unmatchedRanges"] == whole["unmatchedRanges"]
    fp.write_matches(read, str(tmp_path / "again"))
    again = {r["match_id"]: r.asDict(True) for r in fp.read_matches(spark, str(tmp_path / "again")).collect()}
    assert again == rows and set(rows) == {"match-1 a", "m=2"}
    assert fp.read_results(spark, str(tmp_path / "again")).count() == 2


def test_a_match_as_a_document(spark, clip, tmp_path):  # noqa: F811
    short, movie = clip
    got = plan.match(short, movie)
    frames = short.groupBy(F.col("video_id").alias("match_id")).agg(F.count("*").alias("n"))
    stats = spark.createDataFrame([("short", 1, 0, 0, 0, 0, 0)], "match_id string, accepted int, rejected int, inconclusive_network int, other_unverifiable int, recovered_by_deferred int, still_unmatched int")
    fp.write_matches(fp.match_documents(got.segments, got.unmatched, frames, movie.count(), stats), str(tmp_path / "r"))
    r = fp.read_matches(spark, str(tmp_path / "r")).first().asDict(True)
    assert (r["match_id"], r["movieFrames"], r["shortFrames"], r["vlmStats"]["accepted"], r["unmatchedRanges"]) == ("short", 250, 80, 1, [])
    segment = got.segments.first()
    found = r["segments"][0]
    assert len(r["segments"]) == 1 and found["frameCount"] == 80 and found["movieStart"] == segment["movie_start"]
    detail = found["bestFrameDetail"]
    assert detail["cropRegion"] == segment["detail"]["crop"] and len(detail["shortHash"]) == 256 and detail["structureSim"] == segment["detail"]["structure_sim"]
    got.release()
    nothing = fp.match_documents(got.segments.limit(0), got.unmatched.limit(0), frames, 0).first()
    assert nothing["segments"] == [] and nothing["vlmStats"] is None
