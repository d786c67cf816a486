"""Interval algebra over matched segments.

Segments are rows of a match (``match_id``) with ``seg_id``, ``short_start``,
``short_end``, ``movie_start``, ``movie_end``, ``confidence``, ``frame_count``,
``gap_count``, ``speed_ratio`` and ``is_approximate``.  Every operator works per
match, so that matches are dealt out by their id.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import js_round

# Limits in seconds.
MERGE_SHORT = (-0.04, 0.52)
MERGE_MOVIE_BACK = -0.08
OVERLAP = 0.15
SAME_PLACE = 0.5
KEEP_OVERLAP = 0.05
PAIR_SPACING = 0.75
# Rules for keeping doubtful segments.
SURE_CONFIDENCE, SURE_FRAMES, GOOD_NEIGHBOUR = 80.0, 20, 85.0
NEIGHBOUR_GAP = (-1.0, 10.0)
FPS = 25.0
#: Seconds of a time slot by which intervals are dealt out for joins.
SLOT = 30.0


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of the common part; negative where there is none."""
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def merge_adjacent(segments: DataFrame) -> DataFrame:
    """Join segments that go on where the one before ended, in both videos.

    A segment's running ends are those of the row before it, so that runs are
    found by a lag and a running sum.  ``members`` are the joined segments in
    order.  ``detail_seg_id`` names the one whose best frame stands for all: at
    each step the running, frame-weighted confidence against the next one's.
    That mean is carried from step to step, as it is defined: a quotient of sums
    differs from it in the last bit, and a segment as confident as the first one
    would take its place.
    """
    w = Window.partitionBy("match_id").orderBy("short_start", "seg_id")
    short_gap = F.col("short_start") - F.lag("short_end").over(w)
    movie_gap = F.col("movie_start") - F.lag("movie_end").over(w)
    joins = short_gap.between(*MERGE_SHORT) & (movie_gap >= MERGE_MOVIE_BACK) & (movie_gap <= short_gap * 5 + 2.5)
    rows = segments.withColumn("_gap", F.when(joins, js_round(short_gap * FPS))).withColumn("_island", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w))
    last, frames = F.struct("short_start", "seg_id"), F.col("frame_count")
    run = F.array_sort(F.collect_list(F.struct("short_start", "seg_id", F.col("confidence").cast("double").alias("c"), frames.cast("long").alias("f"))))

    def step(acc: Column, x: Column) -> Column:
        f = acc["f"] + x["f"]
        return F.struct(((acc["c"] * acc["f"] + x["c"] * x["f"]) / f).alias("c"), f.alias("f"), F.when(acc["c"] >= x["c"], acc["seg_id"]).otherwise(x["seg_id"]).alias("seg_id"))

    first = F.get("_run", F.lit(0))
    leading = F.aggregate(F.slice("_run", F.lit(2), F.size("_run")), F.struct(first["c"].alias("c"), first["f"].alias("f"), first["seg_id"].alias("seg_id")), step)
    return rows.groupBy("match_id", "_island").agg(
        F.min("short_start").alias("short_start"), F.max_by("short_end", last).alias("short_end"),
        F.min_by("movie_start", last).alias("movie_start"), F.max_by("movie_end", last).alias("movie_end"),
        (F.sum(F.col("confidence") * frames) / F.sum(frames)).alias("confidence"),
        (F.sum(F.col("speed_ratio") * frames) / F.sum(frames)).alias("speed_ratio"),
        F.sum(frames).alias("frame_count"), (F.sum("gap_count") + F.coalesce(F.sum("_gap"), F.lit(0))).alias("gap_count"),
        F.bool_or("is_approximate").alias("is_approximate"), F.count("*").alias("merged"),
        run.alias("_run"),
    ).withColumns({"detail_seg_id": leading["seg_id"], "members": F.transform("_run", lambda x: x["seg_id"])}).drop("_island", "_run")


class _Points:
    """Kept points; one that is ``within`` of a kept one is not taken."""

    def __init__(self, within: float, strict: bool):
        self.within, self.strict, self.kept = within, strict, []

    def take(self, x: float | None) -> bool:
        if x is None or x != x:
            return True
        at = bisect.bisect_left(self.kept, x)
        for k in self.kept[max(0, at - 1) : at + 1]:  # no other one is nearer
            if abs(x - k) < self.within or not self.strict and abs(x - k) == self.within:
                return False
        self.kept.insert(at, x)
        return True


class _Ranges:
    """Kept ranges by time slot; one that overlaps a kept one by more than
    ``limit`` is not taken."""

    def __init__(self, limit: float):
        self.limit, self.kept = limit, {}

    def take(self, start: float | None, end: float | None) -> bool:
        if start is None or end is None or not math.isfinite(start) or not math.isfinite(end):
            return True
        slots = range(math.floor(start / SLOT), math.floor(end / SLOT) + 1)
        if any(min(end, b) - max(start, a) > self.limit for n in slots for a, b in self.kept.get(n, ())):
            return False
        for n in slots:
            self.kept.setdefault(n, []).append((start, end))
        return True


def _in_order(rows: DataFrame, key: list[str], order: list[Column], fields: list[str], fold: Callable, out: str) -> DataFrame:
    """``fold`` over the rows of each key in order, which reach it a batch at a
    time; it gives the columns ``out`` (DDL)."""
    sort = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    dealt = rows.select(*key, *fields, *sort).repartition(*key)
    return dealt.sortWithinPartitions(*key, *[f"_o{i}" for i in range(len(sort))], *fields).select(*key, *fields).mapInArrow(fold, out)


def _ddl(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)


def _folded(rows: DataFrame, key: list[str], order: list[Column], fields: list[str], at: list[str], kept_by: Callable[[], _Points | _Ranges], limit: int | None = None) -> DataFrame:
    """Greedy choice per key: rows in order are kept, up to ``limit``, unless
    they clash with a kept one by their place ``at``; rows without a place clash
    with none.  Only the places of kept rows are held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, n = None, None, 0
        for batch in batches:
            keys = zip(*[batch[c].to_pylist() for c in key], strict=True)
            places = zip(*[batch[c].to_pylist() for c in at], strict=True)
            taken, numbers = [], []
            for row, (k, place) in enumerate(zip(keys, places, strict=True)):
                if kept is None or k != now:
                    now, kept, n = k, kept_by(), 0
                if (limit is None or n < limit) and kept.take(*place):
                    taken.append(row)
                    numbers.append(n)
                    n += 1
            got = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[got[c] for c in key], pa.array(numbers, pa.int32()), *[got[c] for c in fields]], names=[*key, "kept_idx", *fields])

    return _in_order(rows, key, order, fields, fold, f"{_ddl(rows, key)}, kept_idx int, {_ddl(rows, fields)}")


def overlap_dedup(segments: DataFrame, limit: float = OVERLAP) -> DataFrame:
    """Most confident segments first; one that overlaps a kept one by more than
    ``limit`` seconds (0 or more) goes."""
    fields = ["seg_id", "short_start", "short_end", "confidence"]
    return _folded(segments, ["match_id"], [-F.col("confidence"), F.col("seg_id")], fields, ["short_start", "short_end"], lambda: _Ranges(limit))


def near_dedup(rows: DataFrame, key: list[str], order: list[Column], fields: list[str], at: str = "movie_start", within: float = SAME_PLACE, limit: int | None = None) -> DataFrame:
    """Rows in order; one within ``within`` seconds of a kept one goes."""
    return _folded(rows, key, order, fields, [at], lambda: _Points(within, False), limit)


def offset_dedup(rows: DataFrame, key: list[str], separation: int = 50, limit: int | None = 10) -> DataFrame:
    """Aligned candidates (offset, sim), best first, fewer than ``separation``
    frames from a kept one dropped."""
    return _folded(rows, key, [-F.col("sim"), F.col("offset")], ["offset", "sim"], ["offset"], lambda: _Points(separation, True), limit)


def spaced_pairs(points: DataFrame, key: list[str], spacing: float = PAIR_SPACING, most: int = 3) -> DataFrame:
    """The middle point and the most similar ones that are ``spacing`` seconds
    apart: up to ``most`` pairs for a closer look."""
    w = Window.partitionBy(*key).orderBy("ord")
    n = F.count("*").over(Window.partitionBy(*key))
    first = F.row_number().over(w) - 1 == F.floor(n / 2)
    rows = points.withColumn("_first", F.when(first, 0).otherwise(1))
    return _folded(rows, key, [F.col("_first"), -F.col("sim"), F.col("ord")], ["ord", "short_time", "movie_time", "sim"], ["short_time"], lambda: _Points(spacing, True), most)


def context_validate(segments: DataFrame) -> DataFrame:
    """Drop doubtful segments without a good neighbour: the kept one before, or
    the one after, whose movie time fits.  A match of one segment is kept."""
    fields = ["seg_id", "short_start", "movie_start", "movie_end", "confidence", "frame_count", "is_approximate"]
    w = Window.partitionBy("match_id").orderBy("short_start", "seg_id")
    rows = segments.withColumns({"_next": F.lead(F.struct("confidence", "movie_start")).over(w), "_first": F.row_number().over(w) == 1})
    gap = F.col("_next.movie_start") - F.col("movie_end")
    next_good = (F.col("_next.confidence") >= GOOD_NEIGHBOUR) & gap.between(*NEIGHBOUR_GAP)
    sure = ~F.col("is_approximate") | (F.col("confidence") >= SURE_CONFIDENCE) | (F.col("frame_count") >= SURE_FRAMES)
    alone = F.col("_first") & F.col("_next").isNull()
    rows = rows.withColumn("_ok", F.coalesce(sure, F.lit(False)) | F.coalesce(next_good, F.lit(False)) | alone)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = None, None  # match; confidence and movie end of the last kept one
        for batch in batches:
            taken = []
            columns = [batch[c].to_pylist() for c in ("match_id", "_ok", "confidence", "movie_start", "movie_end")]
            for row, (match, ok, confidence, start, end) in enumerate(zip(*columns, strict=True)):
                if match != now:
                    now, before = match, None
                if not ok and before is not None and None not in (*before, start):
                    ok = before[0] >= GOOD_NEIGHBOUR and NEIGHBOUR_GAP[0] <= start - before[1] <= NEIGHBOUR_GAP[1]
                if ok:
                    taken.append(row)
                    before = (confidence, end)
            got = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([got[c] for c in ("match_id", *fields)], names=["match_id", *fields])

    return _in_order(rows, ["match_id"], [F.col("short_start"), F.col("seg_id")], [*fields, "_ok"], fold, _ddl(rows, ["match_id", *fields]))


def unmatched_ranges(frames: DataFrame, used: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, short_start, short_end, frames): runs of frames that no row of
    ``used`` (key, si) covers; a range ends where its last frame begins."""
    free = frames.join(used.select(key, "si").distinct(), [key, "si"], "left_anti")
    run = F.col("si") - F.row_number().over(Window.partitionBy(key).orderBy("si"))
    return free.withColumn("_run", run).groupBy(key, "_run").agg(F.min("ts").alias("short_start"), F.max("ts").alias("short_end"), F.count("*").alias("frames")).drop("_run")


def used_frames(frames: DataFrame, times: DataFrame, key: str = "video_id", digits: int = 4) -> DataFrame:
    """(key, si): frames whose time, to ``digits`` places, occurs in ``times``;
    of frames with the same time the last."""
    at = F.round("ts", digits)
    last = frames.groupBy(key, at.alias("_t")).agg(F.max("si").alias("si"))
    return last.join(times.select(key, at.alias("_t")).distinct(), [key, "_t"], "left_semi").select(key, "si")


def end_correction(segments: DataFrame, short_duration: float | Column, movie_duration: float | Column) -> DataFrame:
    """Ends one frame later: where the last frame ends, not where it begins."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return segments.withColumns({"short_end": F.col("short_end") + lit(short_duration), "movie_end": F.col("movie_end") + lit(movie_duration)})


def joined_by_time(ranges: DataFrame, segments: DataFrame, margin: float = 0.0) -> DataFrame:
    """Ranges (match_id, r_start, r_end) with the segments of their match that
    they overlap, or miss by no more than ``margin``; each pair once.

    Both are dealt out by match and time slot, so that a match with many of them
    is spread, and only what is near meets.
    """
    slot = lambda c: F.floor(c / F.lit(SLOT)).cast("long")
    slots = lambda a, b: F.explode(F.sequence(slot(a), F.greatest(slot(a), slot(b))))
    r_start, r_end = F.col("r_start") - margin, F.col("r_end") + margin
    left = ranges.withColumn("_slot", slots(r_start, r_end))
    right = segments.withColumn("_slot", slots(F.col("short_start"), F.col("short_end")))
    # A pair meets in all slots that both reach; it counts in the first.
    first = F.col("_slot") == slot(F.greatest(r_start, F.col("short_start")))
    return left.join(right, ["match_id", "_slot"]).filter(first).drop("_slot")


def away_from(rows: DataFrame, places: DataFrame, key: list[str], at: str = "movie_start", within: float = SAME_PLACE) -> DataFrame:
    """Rows that lie within ``within`` seconds of no place (key..., ``at``) of
    their key.  Both are dealt out by key and time slot, so that a busy key is
    spread and only what is near meets; rows without a place stay."""
    slot = lambda c: F.floor(c / F.lit(within)).cast("long")
    own = slot(F.col(at))
    near = places.select(*[F.col(c).alias(f"_{c}") for c in key], F.col(at).alias("_at")).filter(F.col("_at").isNotNull()).distinct()
    near = near.withColumn("_slot", F.explode(F.sequence(slot(F.col("_at")) - 1, slot(F.col("_at")) + 1)))
    meet = F.col("_own") == F.col("_slot")
    for c in key:
        meet &= F.col(c) == F.col(f"_{c}")
    return rows.withColumn("_own", own).join(near, meet & (F.abs(F.col(at) - F.col("_at")) <= within), "left_anti").drop("_own")


def alternates(pool: DataFrame, ranges: DataFrame, excluded: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Candidates of each range (match_id, range_id, r_start, r_end): pool rows
    that overlap it by more than 0.15 s and start nowhere near an excluded
    place (match_id, range_id, x_start), most confident first."""
    near = overlap(F.col("short_start"), F.col("short_end"), F.col("r_start"), F.col("r_end")) > OVERLAP
    got = joined_by_time(ranges, pool).filter(near)
    if excluded is not None:
        got = away_from(got, excluded.withColumnRenamed("x_start", "movie_start"), ["match_id", "range_id"])
    w = Window.partitionBy("match_id", "range_id").orderBy(F.desc("confidence"), "seg_id")
    ranked = got.withColumn("rank", F.row_number().over(w))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def candidate_list(originals: DataFrame, others: DataFrame, most: int = 10) -> DataFrame:
    """Places to verify for each range (match_id, range_id): the original
    (seg_id, movie_start) first, then alternates (with ``rank``) that start
    nowhere near one that is listed, up to ``most``; with ``kept_idx``."""
    key = ["match_id", "range_id"]
    first = originals.select(*key, F.lit(0).alias("_n"), F.col("seg_id"), F.col("movie_start"))
    rows = first.unionByName(others.select(*key, F.col("rank").alias("_n"), "seg_id", "movie_start"))
    return near_dedup(rows, key, [F.col("_n")], ["seg_id", "movie_start"], limit=most)


def range_lookup(ranges: DataFrame, segments: DataFrame, within: float = 0.05) -> DataFrame:
    """The segment of each range (match_id, range_id, r_start, r_end): one with
    its bounds within ``within`` seconds, else the one that overlaps it most."""
    exact = (F.abs(F.col("short_start") - F.col("r_start")) <= within) & (F.abs(F.col("short_end") - F.col("r_end")) <= within)
    common = overlap(F.col("short_start"), F.col("short_end"), F.col("r_start"), F.col("r_end"))
    got = joined_by_time(ranges, segments, within).withColumns({"exact": exact, "overlap": common}).filter(F.col("exact") | (F.col("overlap") > 0))
    pick = F.min_by(F.struct("seg_id", "exact", "overlap"), F.struct(~F.col("exact"), F.when(F.col("exact"), 0.0).otherwise(-F.col("overlap")), "seg_id")).alias("p")
    return got.groupBy("match_id", "range_id").agg(pick).select("match_id", "range_id", "p.*")


def keep_best_dropped(candidates: DataFrame, sets: DataFrame, segments: DataFrame) -> DataFrame:
    """For dropped sets (set_id, match_id, r_start, r_end, dropped) without an
    accepted candidate, and clear of all final segments: the checked candidate
    with the highest confidence, the first of equals.  A set of which nothing
    was checked has none."""
    hit = overlap(F.col("short_start"), F.col("short_end"), F.col("r_start"), F.col("r_end")) > KEEP_OVERLAP
    covered = joined_by_time(sets.filter("dropped").select("set_id", "match_id", "r_start", "r_end"), segments.select("match_id", "short_start", "short_end")).filter(hit).select("set_id").distinct()
    lost = sets.filter("dropped").join(covered, "set_id", "left_anti")
    lost = lost.join(candidates.filter("verdict = 'accepted'").select("set_id").distinct(), "set_id", "left_anti")
    best = F.max_by("cand_idx", F.struct(F.coalesce("confidence_pct", F.lit(-1.0)), -F.col("cand_idx"))).alias("cand_idx")
    return candidates.filter("checked").join(lost.select("set_id", "match_id"), "set_id").groupBy("match_id", "set_id").agg(best)


def adjust(candidates: DataFrame, edge: str = "edge", delta: str = "delta") -> DataFrame:
    """Move one edge of the movie range by up to a second: starts stay at 0 or
    later and at least half a second before the end; ``valid`` says whether the
    step was allowed."""
    step = F.when(F.abs(F.col(delta)) <= 1.0, F.col(delta))
    start = F.when(F.col(edge) == "start", F.greatest(F.lit(0.0), F.col("movie_start") + step)).otherwise(F.col("movie_start"))
    end = F.when(F.col(edge) == "end", F.col("movie_end") + step).otherwise(F.col("movie_end"))
    ok = step.isNotNull() & (end - start >= 0.5)
    ok = F.coalesce(ok, F.lit(False))
    return candidates.withColumns({"valid": ok, "new_start": F.when(ok, start).otherwise(F.col("movie_start")), "new_end": F.when(ok, end).otherwise(F.col("movie_end"))})


def select_candidate(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """Segments with the chosen candidate (match_id, seg_id, and new times and
    confidence) put in the place of the active one; ``swapped`` says where."""
    fields = ["short_start", "short_end", "movie_start", "movie_end", "confidence"]
    new = chosen.select("match_id", "seg_id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_new"))
    got = segments.join(new, ["match_id", "seg_id"], "left")
    got = got.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).withColumn("swapped", F.coalesce("_new", F.lit(False)))
    return got.drop("_new", *[f"_{c}" for c in fields])
