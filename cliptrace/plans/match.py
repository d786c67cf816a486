"""The matching plan: cuts, chunks, alignment, interval algebra.

Frames are rows (video_id, si, ts, variants, color, skin, detail).  Cuts and
chunks are window functions; each chunk of a short is aligned on its own by an
Arrow function; what follows is relational.

Movies of up to ``WHOLE_FRAMES`` frames are packed into blocks, and meet groups of
chunks of about ``SHORT_FRAMES`` frames, as long as no more than ``COPIED_FRAMES``
movie frames are copied for it.  Longer movies, and more shorts, are aligned by
ranges (``ranges``): movies stay where they are, and no task holds one.  Both
ways give the same rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.blocks import CHANNELS, Frames, Layout
from ..operators import frames as fr
from ..operators import intervals as iv
from .align import MAIN, Aligner, Profile, least_frames
from .ranges import align_ranges

#: Frames of shorts that are aligned with a movie in one group, about.
SHORT_FRAMES = 100
#: Frames (2 to 4 KB each) of a movie that a task may hold, and frames of movies
#: that are copied to groups of shorts; beyond them movies are cut in ranges.
WHOLE_FRAMES, COPIED_FRAMES = 20_000, 5_000_000
_FEATURES = ["si", "ts", "variants", "color", "skin", "detail"]
_DETAIL = "struct<crop: string, structure_sim: double, color_sim: double, skin_sim: double, detail_sim: double, short_hash: array<bigint>, movie_hash: array<bigint>>"
_OUT = (
    "match_id string, short_id string, movie_id string, chunk_id long, seg_id long, kind string, stage string, short_start double, short_end double, movie_start double, movie_end double, confidence double, "
    f"frame_count int, gap_count int, speed_ratio double, is_approximate boolean, best_si long, best_mi long, detail {_DETAIL}, "
    "sequence array<struct<short_time: double, movie_time: double, similarity: double, si: long, mi: long>>"
)
#: Segments of a chunk, at most, in numbers of segments.
_PER_CHUNK = 1_000_000


@dataclass
class Match:
    """What a match gives.  ``segments``: the final ones.  ``unmatched``: runs of
    frames that none of them covers.  ``alternates``: other places of each
    chunk.  ``pool``: all segments before those that overlap better ones were
    dropped, and the alternates.  All of them read the aligned rows, which stay
    cached until ``release`` is called."""

    segments: DataFrame
    unmatched: DataFrame
    alternates: DataFrame
    pool: DataFrame
    release: Callable[[], object] = lambda: None


def _whole(variants: str | Column) -> Column:
    return F.coalesce(F.get(F.filter(variants, lambda v: v["name"] == "full"), F.lit(0)), F.get(variants, F.lit(0)))


def with_cuts(short: DataFrame) -> DataFrame:
    """Add ``is_cut``, and the color motion ``t_delta`` and ``t_mag``."""
    whole = _whole("variants")
    return fr.scene_cuts(fr.motion(short).withColumns({"a": whole["a"], "d": whole["d"]})).drop("a", "d")


def _layouts(frames: DataFrame) -> DataFrame:
    """(video_id, layout) of the first frame of each video."""
    lead = F.get("variants", F.lit(0))
    words = F.struct(*[F.greatest(F.coalesce(F.size(lead[c]), F.lit(0)), F.lit(0)).alias(c) for c in CHANNELS])
    layout = F.struct(F.transform("variants", lambda v: v["name"]).alias("names"), words.alias("words"))
    return frames.groupBy("video_id").agg(F.min_by(layout, "si").alias("layout"))


def _packed(movie: DataFrame) -> DataFrame:
    """(movie_id, block): frames of a movie, a batch of them in each block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for movie_id in table["movie_id"].unique().to_pylist():
                mine = table.filter(pa.compute.equal(table["movie_id"], movie_id)) if movie_id is not None else table.slice(0, 0)
                if mine.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([movie_id]), pa.array([pickle.dumps(Frames.from_arrow(mine), 5)])], names=["movie_id", "block"])

    return movie.select("movie_id", *_FEATURES).mapInArrow(pack, "movie_id string, block binary")


def _rows(found: list[tuple], ids: tuple[str, str, int], short: Frames, single: bool) -> list[dict]:
    """Rows of a chunk from its segments and alternates, each with its summary
    and steps.  Alternates are numbered after the segments."""
    short_id, movie_id, chunk_id = ids
    rows = []
    for place, (kind, _, x, s, steps) in enumerate(found):
        rows.append(s | {
            "match_id": short_id if single else f"{short_id}/{movie_id}", "short_id": short_id, "movie_id": movie_id, "chunk_id": chunk_id,
            "seg_id": chunk_id * _PER_CHUNK + place, "kind": kind, "stage": x["stage"], "is_approximate": bool(x["approximate"]), "best_si": int(short.si[s["best_si"]]), "sequence": steps,
        })
    return rows


def align(short: DataFrame, movie: DataFrame, profile: Profile = MAIN, min_similarity: float = 82, min_consecutive: int = 9, drift: int = 3, single: bool = True) -> DataFrame:
    """Segments and alternates of all chunks of the shorts against a movie or,
    if not ``single``, against every movie (by its ``video_id``).  Where movies
    are cut in ranges, this runs the rounds of their alignment."""
    short = short.withColumn("video_id", F.col("video_id").cast("string"))
    movie = movie.withColumn("movie_id", F.lit("movie") if single else F.col("video_id").cast("string"))
    w = fr.in_order("video_id", "si")
    cut = with_cuts(short).withColumn("chunk_id", F.sum(F.col("is_cut").cast("int")).over(w))
    least = least_frames(profile, min_consecutive)
    if least > 1:  # nothing is scanned for chunks in which nothing can be found
        size = F.count("*").over(Window.partitionBy("video_id", "chunk_id"))
        cut = cut.withColumn("_n", size).filter(F.col("_n") >= least).drop("_n")
    groups = max(1, math.ceil(short.count() / SHORT_FRAMES))
    salt = F.pmod(F.xxhash64("video_id", "chunk_id"), F.lit(groups)).cast("int").alias("salt")
    chunks = cut.join(_layouts(short), "video_id").select("video_id", "chunk_id", "is_cut", "t_delta", "t_mag", "layout", *_FEATURES, salt)
    schema = to_arrow_schema(short.sparkSession.createDataFrame([], _OUT).schema)
    sizes = movie.groupBy("movie_id").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (sizes["most"] or 0) > WHOLE_FRAMES or (sizes["all"] or 0) * groups > COPIED_FRAMES:
        found = align_ranges(chunks, movie, profile, min_similarity, min_consecutive, drift)

        def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    short, result = pickle.loads(r["payload"])
                    yield pa.RecordBatch.from_pylist(_rows(result, (r["short_id"], r["movie_id"], r["chunk_id"]), short, single), schema=schema)

        return found.mapInArrow(decoded, _OUT)
    # A chunk meets each movie: its key is the movie and the group of chunks.
    all_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("salt")
    if single:
        left = chunks.withColumn("movie_id", F.lit("movie"))
    else:
        left = chunks.join(movie.select("movie_id").distinct().select("movie_id", all_groups), "salt")
    right = _packed(movie).select("*", all_groups)

    def many(key: tuple, mine: pa.Table, blocks: pa.Table) -> pa.Table:
        rows: list[dict] = []
        if mine.num_rows and blocks.num_rows:
            frames = Frames.joined([pickle.loads(b.as_buffer()) for c in blocks["block"].chunks for b in c])
            mine = mine.sort_by([("video_id", "ascending"), ("chunk_id", "ascending"), ("si", "ascending")])
            names, ids = mine["video_id"].to_pylist(), mine["chunk_id"].to_numpy()
            begin = [k for k in range(mine.num_rows) if not k or names[k] != names[k - 1] or ids[k] != ids[k - 1]]
            for a, b in zip(begin, [*begin[1:], mine.num_rows], strict=True):
                part = mine.slice(a, b - a)
                found = part["layout"][0].as_py()
                layout = Layout(found["names"], {c: n for c, n in found["words"].items() if n})
                one = Frames.from_arrow(part, layout)
                aligner = Aligner(one, frames, np.append(part["is_cut"].to_numpy(), True), profile, drift)
                rows += _rows(aligner.whole_chunk(min_similarity, min_consecutive), (names[a], key[0].as_py(), int(ids[a])), one, single)
        return pa.Table.from_pylist(rows, schema=schema)

    return left.groupBy("movie_id", "salt").cogroup(right.groupBy("movie_id", "salt")).applyInArrow(many, _OUT)


def match(short: DataFrame, movie: DataFrame, profile: Profile = MAIN, min_similarity: float = 82, min_consecutive: int = 9, drift: int = 3, single: bool = True) -> Match:
    """Segments, unmatched ranges and alternates of shorts against a movie.

    All rows of ``movie`` are one video, whatever their ``video_id``; with
    ``single`` false each ``video_id`` is a movie of its own, every short is
    matched with each, and ``match_id`` names both.  Parameters out of range
    fall back to 82, 9 and 3.
    """
    min_similarity = min_similarity if 0 < min_similarity <= 100 else 82
    min_consecutive = min_consecutive if min_consecutive >= 1 else 9
    drift = drift if drift >= 0 else 3
    short = short.withColumn("video_id", F.col("video_id").cast("string"))
    found = align(short, movie, profile, min_similarity, min_consecutive, drift, single).cache()
    raw = found.filter("kind = 'segment'")
    about = raw.select("match_id", F.col("seg_id").alias("detail_seg_id"), "short_id", "movie_id", "best_si", "best_mi", "detail")
    merged = iv.merge_adjacent(raw).join(about, ["match_id", "detail_seg_id"]).withColumnRenamed("detail_seg_id", "seg_id")
    kept = iv.context_validate(merged.join(iv.overlap_dedup(merged).select("match_id", "seg_id"), ["match_id", "seg_id"], "left_semi"))
    final = merged.join(kept.select("match_id", "seg_id"), ["match_id", "seg_id"], "left_semi")
    # Frames are used if a sequence of a final segment has their time.
    members = final.select("match_id", F.explode("members").alias("seg_id"))
    times = raw.join(members, ["match_id", "seg_id"], "left_semi").select("match_id", F.explode("sequence.short_time").alias("ts"))
    frames = short.select("video_id", "si", "ts")
    if single:
        frames = frames.withColumnRenamed("video_id", "match_id")
    else:
        pairs = short.select(F.col("video_id").alias("_s"), F.lit(1).alias("_k")).distinct().join(movie.select(F.col("video_id").cast("string").alias("_m"), F.lit(1).alias("_k")).distinct(), "_k")
        frames = frames.join(pairs, F.col("video_id") == F.col("_s")).select(F.concat_ws("/", "_s", "_m").alias("match_id"), "si", "ts")
    used = iv.used_frames(frames, times, "match_id").distinct()
    free = iv.unmatched_ranges(frames, used, "match_id").withColumnRenamed("match_id", "video_id" if single else "match_id")
    movies = movie.select(F.lit("movie").alias("video_id") if single else F.col("video_id").cast("string"), "si", "ts")
    steps = fr.frame_duration(short.select("video_id", "si", "ts")).select(F.col("video_id").alias("short_id"), F.col("duration").alias("_ss"))
    others = fr.frame_duration(movies).select(F.col("video_id").alias("movie_id"), F.col("duration").alias("_ms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))

    def corrected(df: DataFrame) -> DataFrame:
        return iv.end_correction(df.join(steps, "short_id", "left").join(others, "movie_id", "left"), zero("_ss"), zero("_ms")).drop("_ss", "_ms")

    alternates = corrected(found.filter("kind = 'alternate'"))
    everything = corrected(merged).drop("members", "merged")
    pool = everything.unionByName(alternates.select(*everything.columns))
    return Match(corrected(final), free, alternates, pool, found.unpersist)
