"""Fingerprint tables: NDJSON and JSON readers, Parquet store, result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import pack_text
from ..operators.jobs import recovered_match, recovered_status

_VARIANT = "STRUCT<hash: STRING, dhash: STRING, fhash: STRING, fdhash: STRING, phash: STRING>"
#: A frame as it is written: one JSON object a line.
FRAME_JSON = f"frameIndex INT, timestamp DOUBLE, variants MAP<STRING, {_VARIANT}>, signature STRUCT<colorGrid: ARRAY<DOUBLE>, skinScoreGrid: ARRAY<DOUBLE>, detailGrid: ARRAY<DOUBLE>>"
_SEGMENT = (
    "STRUCT<shortStart: DOUBLE, shortEnd: DOUBLE, movieStart: DOUBLE, movieEnd: DOUBLE, confidence: DOUBLE, frameCount: INT, isApproximate: BOOLEAN, gapCount: INT, speedRatio: DOUBLE, "
    "matchSequence: ARRAY<STRUCT<shortTime: DOUBLE, movieTime: DOUBLE, similarity: DOUBLE>>, "
    "bestFrameDetail: STRUCT<cropRegion: STRING, structureSim: DOUBLE, colorSim: DOUBLE, skinSim: DOUBLE, detailSim: DOUBLE, movieHash: STRING, shortHash: STRING>>"
)
RESULT_JSON = (
    f"segments ARRAY<{_SEGMENT}>, unmatchedRanges ARRAY<STRUCT<shortStart: DOUBLE, shortEnd: DOUBLE>>, movieFrames INT, shortFrames INT, "
    "vlmStats STRUCT<accepted: INT, rejected: INT, inconclusiveNetwork: INT, otherUnverifiable: INT, recoveredByDeferred: INT, stillUnmatchedAfterDeferred: INT>"
)
CANDIDATES_JSON = (
    "matchJobId STRING, segmentIndex INT, shortStart DOUBLE, shortEnd DOUBLE, recordedAt LONG, dropped BOOLEAN, bestEffort BOOLEAN, broaderSearchRounds INT, recoveredCandidateIndex INT, "
    f"candidates ARRAY<STRUCT<segment: {_SEGMENT}, checked: BOOLEAN, verdict: STRING, confidencePct: DOUBLE, matchLikelihood: DOUBLE, evidence: ARRAY<STRING>>>"
)
META_JSON = "originalName STRING, fileSize LONG, createdAt LONG, startedAt LONG, completedAt LONG, totalFrames INT, status STRING, videoPath STRING, movieJobId STRING, shortJobId STRING, error STRING"


def _video(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:_fingerprints)?\.(?:nd)?jsonl?$", 1)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Frames of one-object-a-line files; broken lines are dropped."""
    raw = spark.read.schema(FRAME_JSON).option("mode", "DROPMALFORMED").json(path)
    return raw.filter("frameIndex IS NOT NULL").withColumn("video_id", _video(F.input_file_name()))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Frames of files that hold one JSON array."""
    return spark.read.schema(FRAME_JSON).option("multiLine", True).json(path).filter("frameIndex IS NOT NULL").withColumn("video_id", _video(F.input_file_name()))


def pack(frames: DataFrame) -> DataFrame:
    """Frame rows (video_id, si, ts, variants, color, skin, detail) with packed
    hashes; variants are in name order with ``full`` first.  Frames of the same
    index are taken once."""
    name = F.col("e.key")
    word = lambda c: F.when(F.col(f"e.value.{c}").isNotNull(), pack_text(F.col(f"e.value.{c}")))
    one = F.struct((name != "full").alias("late"), name.alias("name"), word("hash").alias("a"), word("dhash").alias("d"), word("fhash").alias("fa"), word("fdhash").alias("fd"), word("phash").alias("p"))
    once = frames.dropDuplicates(["video_id", "frameIndex"])
    listed = once.select("*", F.explode(F.map_entries("variants")).alias("e")).groupBy("video_id", "frameIndex").agg(F.sort_array(F.collect_list(one)).alias("variants"), F.first("timestamp").alias("ts"), F.first("signature").alias("sig"))
    return listed.select("video_id", (F.col("frameIndex") - 1).cast("long").alias("si"), "ts", F.transform("variants", lambda v: v.dropFields("late")).alias("variants"),
                         F.col("sig.colorGrid").alias("color"), F.col("sig.skinScoreGrid").alias("skin"), F.col("sig.detailGrid").alias("detail"))


def write_store(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Frames as Parquet, one folder a video, ordered within it: a range of
    frames is then read by row-group statistics.  Long videos are dealt out over
    several files by ranges of frames."""
    frames.repartitionByRange("video_id", "si").sortWithinPartitions("video_id", "si").write.mode(mode).partitionBy("video_id").parquet(path)


def read_store(spark: SparkSession, path: str, video_id: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Frames of the store; the video and the range reach the scan.  Names of
    videos are texts, also where all of them look like numbers."""
    kept = [T.StructField(f.name, T.StringType()) if f.name == "video_id" else f for f in spark.read.parquet(path).schema]
    df = spark.read.schema(T.StructType(kept)).parquet(path)
    if video_id is not None:
        df = df.filter(F.col("video_id") == video_id)
    if first is not None:
        df = df.filter(F.col("si") >= first)
    if last is not None:
        df = df.filter(F.col("si") <= last)
    return df


def resume_after(frames: DataFrame, store: DataFrame) -> DataFrame:
    """Frames that the store lacks, by video and index: a run that broke off
    goes on without writing anything twice."""
    return frames.join(store.select("video_id", "si"), ["video_id", "si"], "left_anti")


def between(frames: DataFrame, start: float, end: float) -> DataFrame:
    """Frames of a time range."""
    return frames.filter(F.col("ts").between(start, end))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Match-result files, one row each: ``match_id``, segments with their best
    frames, unmatched ranges, numbers of frames, and what verification found.
    Reads what ``write_matches`` wrote as well."""
    raw = spark.read.schema(RESULT_JSON).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    path_of = plain(F.input_file_name())  # the name of a folder of a table is encoded once more
    named = F.regexp_extract(path_of, r"([^/]+)_matchresult\.json$", 1)
    folder = plain(F.regexp_extract(path_of, r"match_id=([^/]+)/[^/]+$", 1))
    return raw.select(F.when(named != "", named).otherwise(folder).alias("match_id"), *raw.columns)


def write_matches(matches: DataFrame, path: str) -> None:
    """Match results as JSON, one object below the folder of each match: rows
    of ``read_matches``."""
    matches.repartition("match_id").write.mode("overwrite").partitionBy("match_id").json(path)


def match_documents(segments: DataFrame, unmatched: DataFrame, short_frames: DataFrame, movie_frames: int, stats: DataFrame | None = None) -> DataFrame:
    """Rows of ``read_matches`` from what a match gives: final segments, runs of
    unmatched frames (match_id or video_id), frames of the shorts (match_id, n)
    and tallies of ``outcome_tallies`` (match_id, counts)."""
    text = lambda words: F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.reverse(F.lpad(F.bin(w), 32, "0"))), "")).otherwise("")
    d = lambda c: F.col(f"detail.{c}")
    best = F.when(F.col("detail").isNotNull(), F.struct(d("crop").alias("cropRegion"), d("structure_sim").alias("structureSim"), d("color_sim").alias("colorSim"), d("skin_sim").alias("skinSim"), d("detail_sim").alias("detailSim"), text(d("movie_hash")).alias("movieHash"), text(d("short_hash")).alias("shortHash")))
    steps = F.transform("sequence", lambda x: F.struct(x["short_time"].alias("shortTime"), x["movie_time"].alias("movieTime"), x["similarity"].alias("similarity"))) if "sequence" in segments.columns else F.array().cast("array<struct<shortTime: double, movieTime: double, similarity: double>>")
    renamed = {"short_start": "shortStart", "short_end": "shortEnd", "movie_start": "movieStart", "movie_end": "movieEnd", "confidence": "confidence", "frame_count": "frameCount", "is_approximate": "isApproximate", "gap_count": "gapCount", "speed_ratio": "speedRatio"}
    one = F.struct(*[F.col(c).alias(n) for c, n in renamed.items()], steps.alias("matchSequence"), best.alias("bestFrameDetail"))
    found = segments.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("short_start", "seg_id", one.alias("x")))).alias("s")).select("match_id", F.col("s.x").alias("segments"))
    key = "match_id" if "match_id" in unmatched.columns else "video_id"
    free = unmatched.groupBy(F.col(key).alias("match_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("short_start").alias("shortStart"), F.col("short_end").alias("shortEnd")))).alias("unmatchedRanges"))
    out = short_frames.select("match_id", F.lit(movie_frames).cast("int").alias("movieFrames"), F.col("n").cast("int").alias("shortFrames")).join(found, "match_id", "left").join(free, "match_id", "left")
    names = {"accepted": "accepted", "rejected": "rejected", "inconclusive_network": "inconclusiveNetwork", "other_unverifiable": "otherUnverifiable", "recovered_by_deferred": "recoveredByDeferred", "still_unmatched": "stillUnmatchedAfterDeferred"}
    if stats is None:
        said = F.lit(None).cast("struct<" + ", ".join(f"{n}: int" for n in names.values()) + ">")
    else:
        out = out.join(stats.select("match_id", F.struct(*[F.col(c).cast("int").alias(n) for c, n in names.items()]).alias("_said")), "match_id", "left")
        said = F.col("_said")
    none = F.array()
    return out.select("match_id", F.coalesce("segments", none).alias("segments"), F.coalesce("unmatchedRanges", none).alias("unmatchedRanges"), "movieFrames", "shortFrames", said.alias("vlmStats"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Segments of match-result files, one row each, with ``match_id`` and
    ``segment_idx``."""
    raw = read_matches(spark, path)
    return raw.select("match_id", "movieFrames", "shortFrames", F.posexplode("segments").alias("segment_idx", "s")).select("match_id", "movieFrames", "shortFrames", "segment_idx", "s.*")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of candidate-set files, one row each."""
    raw = spark.read.schema(CANDIDATES_JSON).option("multiLine", True).json(path).withColumn("match_id", F.regexp_extract(F.input_file_name(), r"([^/]+)_candidates_\d+\.json$", 1))
    head = ["match_id", "segmentIndex", "shortStart", "shortEnd", "dropped", "bestEffort", "broaderSearchRounds", "recoveredCandidateIndex"]
    return raw.select(*head, F.posexplode("candidates").alias("cand_idx", "c")).select(*head, "cand_idx", "c.*")


def history(spark: SparkSession, path: str) -> DataFrame:
    """What a folder of results says of its jobs after a restart: (job_id, kind,
    state, error, parts, files), from file names and meta files.

    A video is completed with a result and no checkpoint; what was running, or
    lacks its result, has failed.  A match that was running has failed, and so
    has a completed one without its result.  Broken meta files count as none;
    jobs of which nothing is known have no row.
    """
    pattern = r"([^/]+?)_(meta|matchmeta|matchresult|result|fingerprints|checkpoint|candidates)(?:_\d+)?\.(?:nd)?jsonl?$"
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.*json*").load(path).select("path")
    # Only meta files are opened; frames may be of any size.
    meta = spark.read.format("binaryFile").option("pathGlobFilter", "*_{meta,matchmeta}.json").load(path).select("path", F.col("content").cast("string").alias("meta"))
    files = listed.join(meta, "path", "left")
    named = files.select(F.regexp_extract("path", pattern, 1).alias("job_id"), F.regexp_extract("path", pattern, 2).alias("part"), F.from_json("meta", META_JSON).alias("m")).filter("job_id <> ''")
    has = lambda *parts: F.bool_or(F.col("part").isin(*parts))
    grouped = named.groupBy("job_id").agg(
        F.sort_array(F.collect_set("part")).alias("parts"), F.count("*").alias("files"), F.max("m.status").alias("said"), F.max("m.error").alias("told"),
        has("meta", "matchmeta").alias("known"), has("matchmeta", "matchresult", "candidates").alias("match"), has("result", "fingerprints").alias("result"),
        has("matchresult").alias("matched"), has("checkpoint").alias("open"),
    )
    match_state = F.when((F.col("said") == "completed") & ~F.col("matched"), "failed").otherwise(recovered_match(F.col("said")))
    video_state = recovered_status(F.coalesce(F.col("said"), F.when(F.col("known"), F.lit("unknown"))), F.col("result"), F.col("open"))
    state = F.when(F.col("match"), match_state).otherwise(video_state)
    error = F.when(F.col("match") & (F.col("said") == "processing"), F.coalesce("told", F.lit("Interrupted by server restart"))).when(
        F.col("match") & (F.col("said") == "completed") & ~F.col("matched"), "Result file missing"
    ).otherwise(F.col("told"))
    out = grouped.select("job_id", F.when(F.col("match"), "match").otherwise("video").alias("kind"), state.alias("state"), error.alias("error"), "parts", "files")
    return out.filter("state IS NOT NULL")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Meta files of jobs and matches, times as timestamps."""
    raw = spark.read.schema(META_JSON).option("multiLine", True).json(path).withColumn("job_id", F.regexp_extract(F.input_file_name(), r"([^/]+)_(?:match)?meta\.json$", 1))
    return raw.withColumns({c: F.timestamp_millis(c) for c in ("createdAt", "startedAt", "completedAt")})


def write_results(segments: DataFrame, path: str) -> None:
    """Segments as JSON, one folder a match."""
    segments.write.mode("overwrite").partitionBy("match_id").json(path)


def write_ndjson(frames: DataFrame, path: str) -> None:
    """Packed frames as lines of JSON, a folder a video, in order of frames:
    what ``read_ndjson`` and ``pack`` read back.  Long videos have several
    files, whose names are in that order too."""
    text = lambda words: F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.reverse(F.lpad(F.bin(w), 32, "0"))), ""))
    fields = {"hash": "a", "dhash": "d", "fhash": "fa", "fdhash": "fd", "phash": "p"}
    one = lambda v: F.struct(v["name"].alias("key"), F.struct(*[text(v[c]).alias(n) for n, c in fields.items()]).alias("value"))
    grids = F.struct(F.col("color").alias("colorGrid"), F.col("skin").alias("skinScoreGrid"), F.col("detail").alias("detailGrid"))
    signature = F.when(F.coalesce(F.col("color"), F.col("skin"), F.col("detail")).isNotNull(), grids)
    rows = frames.select("video_id", "si", (F.col("si") + 1).cast("int").alias("frameIndex"), F.col("ts").alias("timestamp"), F.map_from_entries(F.transform("variants", one)).alias("variants"), signature.alias("signature"))
    rows.repartitionByRange("video_id", "si").sortWithinPartitions("video_id", "si").drop("si").write.mode("overwrite").partitionBy("video_id").json(path)


def complete_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, lines): lines of each plain file that end in a line feed; what a
    run that broke off has written for sure.

    Lines are counted where they are read, so that files of any size are split.
    A file's last line is whole if all lines with their line feeds are as long
    as the file.  An empty file has no row.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    whole = F.sum(F.octet_length("value").cast("long") + 1) <= F.max("size")
    return rows.groupBy("path").agg((F.count("*") - F.when(whole, 0).otherwise(1)).alias("lines"))


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Candidate sets as JSON, one object a set below its match: rows of
    ``read_candidates`` (set fields, cand_idx, and each candidate's fields)."""
    head = ["match_id", "segmentIndex", "shortStart", "shortEnd", "dropped", "bestEffort", "broaderSearchRounds", "recoveredCandidateIndex"]
    own = [c for c in candidates.columns if c not in (*head, "cand_idx")]
    sets = candidates.groupBy(*head).agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_idx", *own))), lambda c: F.struct(*[c[n].alias(n) for n in own])).alias("candidates"))
    sets.repartition("match_id").write.mode("overwrite").partitionBy("match_id").json(path)


def write_meta(jobs: DataFrame, path: str) -> None:
    """Meta data of jobs as JSON, times in milliseconds, a folder a job."""
    times = {c: F.unix_millis(c) for c in ("createdAt", "startedAt", "completedAt") if dict(jobs.dtypes).get(c) == "timestamp"}
    jobs.withColumns(times).write.mode("overwrite").partitionBy("job_id").json(path)
