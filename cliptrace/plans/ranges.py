"""Alignment with movies of any length: no task holds a movie.

A movie is cut into pages of about ``PAGE`` frames, which stay where they are.
Chunks of shorts are aligned in rounds.  In a round each open chunk goes on with
what it has been answered, as far as that takes it, and states what it lacks;
tasks that hold a range of pages answer:

* scans of a short frame over the whole movie go to all ranges; a range returns
  the leaders of its frames, the best frame, or plain similarities, and the chunk
  joins those of all ranges;
* a walk goes to the range where it is, and on to the next one if it leaves
  that with what lies ``MARGIN`` frames around it;
* single similarities, times and details go to the range of their frame.

What travels are frames of shorts, walks and answers, never a movie's pages; a
chunk keeps what it has learnt in a few numbers for each leader and step.

A range cannot know where the last leader of the range before stands.  But a
frame above all that pass within ``SEPARATION`` frames before it leads whatever
that is.  From the first such frame on a range's leaders stand; the frames before
it are returned as they are, and joined in order.

Results are those of ``align`` with the whole movie at hand.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import Frames, Layout, best_sims, frame_detail, frame_sims
from ..operators.scan import SEPARATION
from ..shared import Tables
from .align import SECOND_PASS, Aligner, Missing, Profile, Walk, lead

#: Frames of a page, and pages of a range.
PAGE, RANGE_PAGES = 128, 128
#: Frames around a range that its task holds as well, at least: a walk that leaves
#: them is well inside the next range.
MARGIN = 256
#: Bytes of answers in a batch, about.
BATCH_BYTES = 8 << 20
#: Leaders of a range that are returned: more than any step looks at.  The pool
#: takes up to 24 offsets from 3 scans; each of these rules out no more than two
#: leaders of another scan.
MOST_LEADERS = 160
#: Rounds of one alignment, at most; more are an error.
MOST_ROUNDS = 500
_DONE, _STATE, _ASKED, _SAID = "done", "state", "asked", "said"
_ROWS = "movie_id string, short_id string, chunk_id long, what string, ranges array<long>, payload binary"
#: Tasks' worth of ranges: few ranges are dealt out to groups of chunks.
_DEALT = 8
_FEATURES = ["si", "ts", "variants", "color", "skin", "detail"]


def marks(sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames above all of the ``SEPARATION`` - 1 before them, and tops, which none of
    those after them is above.  A floor changes neither for a frame that passes it."""
    return sims > _before(sims, SEPARATION - 1), sims >= _before(sims[::-1], SEPARATION - 1)[::-1]


def range_leaders(sims: np.ndarray, first: int, floor: float | None, most: int = MOST_LEADERS, marked: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list, list]:
    """What a range tells of its leaders: frames (mi, sim) up to and with the one
    from which on its leaders stand, and the leaders from there, by position: the
    ``most`` best and the last.

    A leader moves until it meets a top, and that is the first top from where it
    began.  So leaders are tops that stand apart, taken from the left.  Up to the
    frame from which they stand, tops are told, and the frames that lead to the first
    of them, each of which is above all before it: no other frame changes what leads."""
    sure, top = marks(sims) if marked is None else marked
    if floor is not None:
        passing = sims >= floor
        sure, top = sure & passing, top & passing
    tops = np.flatnonzero(top)
    if not len(tops):
        return [], []
    open_from = SEPARATION - 1 if first else 0  # frames of the range before count as well
    start = open_from + int(sure[open_from:].argmax()) if sure[open_from:].any() else len(sims)
    rising = sims[: tops[0] + 1] if floor is None else np.where(passing[: tops[0] + 1], sims[: tops[0] + 1], -np.inf)
    rising = np.flatnonzero(rising > np.append(-np.inf, np.maximum.accumulate(rising)[:-1]))
    told = {k for some in (rising, tops[: np.searchsorted(tops, start)]) for k in some.tolist() if k < start} | ({start} if start < len(sims) else set())
    picked, edge = [], start
    for k in tops[np.searchsorted(tops, start) :].tolist():
        if k >= edge:
            picked.append(k)
            edge = k + SEPARATION
    some = np.array(picked[:-1], np.int64)
    if len(some) > most:
        some = np.sort(some[np.lexsort((some, -sims[some]))[:most]])
    with_sims = lambda places: [(first + k, s) for k, s in zip(places, sims[places].tolist(), strict=True)]
    return with_sims(sorted(told)) if told else [], with_sims([*some.tolist(), *picked[-1:]]) if picked else []


def _before(shown: np.ndarray, reach: int) -> np.ndarray:
    """The largest of the ``reach`` values before each; of windows twice as long
    at each step."""
    most = np.concatenate((np.full(reach, -np.inf), shown))[:-1]  # window of one, ``reach`` places on
    n, width = len(shown), 1
    while 2 * width <= reach:
        most = np.maximum(most[:-width], most[width:])
        width *= 2
    # Two windows that overlap cover the reach.
    return np.maximum(most[:n], most[reach - width : reach - width + n])


def all_leaders(sims: np.ndarray, first: int, floors: tuple, most: tuple = ()) -> list[tuple[list, list]]:
    """``range_leaders`` for each floor; floors that all frames pass have the same."""
    least, known, out = sims.min() if len(sims) else 0.0, None, []
    rest = *(most or (MOST_LEADERS,)), marks(sims)
    for floor in floors:
        if floor is not None and not least >= floor:
            out.append(range_leaders(sims, first, floor, *rest))
            continue
        known = range_leaders(sims, first, None, *rest) if known is None else known
        out.append(known)
    return out


def join_leaders(parts: list[tuple[list, list]]) -> list[tuple[int, float]]:
    """Leaders of a movie from those of its ranges in order, best first."""
    kept: list[list] = []
    for open_part, leaders in parts:
        for mi, sim in open_part:
            lead(kept, mi, sim)
        if leaders:
            kept.pop()  # the last open frame: it leads now, and the leaders go on from it
            kept += [list(x) for x in leaders]
    return sorted(((m, s) for m, s in kept), key=lambda x: -x[1])


def some_frames(s: Frames, rows: list[int]) -> Frames:
    """Some frames, with their motion."""
    grids = {g: (values[rows], has[rows]) for g, (values, has) in s.grids.items()}
    some = Frames(s.si[rows], s.ts[rows], {c: x[rows] for c, x in s.hashes.items()}, s.layout, grids)
    motion = [s.motion(k, k + 1) for k in rows]
    some.delta, some.mag = np.concatenate([d for d, _ in motion]), np.concatenate([m for _, m in motion])
    return some


class Range:
    """What a task holds of a movie: a range of places, and frames around it."""

    def __init__(self, part: Frames, first: int, lo: int, hi: int, n: int, profile: Profile, drift: int):
        self.part, self.first, self.lo, self.hi, self.n, self.profile, self.drift = part, first, lo, hi, n, profile, drift
        self.seen: tuple[Frames | None, dict[tuple[int, int, int], np.ndarray]] = (None, {})

    def window(self, s: Frames, si: int, lo: int, hi: int) -> np.ndarray:
        """Similarities of a frame of a walk, which walks on the same way ask for again."""
        if self.seen[0] is not s:
            self.seen = s, {}
        known, at = self.seen[1], (si, lo, hi)
        if at not in known:
            known[at] = frame_sims(s, si, self.part, lo - self.first, hi - self.first)
        return known[at]

    def answer(self, asked: tuple, s: Frames, k: int, more: tuple | None) -> object:
        """What the range says to what is asked of frame ``k``; ``more``: the walk,
        and where it may not go."""
        first, a, b = self.first, self.lo - self.first, self.hi - self.first
        kind = asked[0]
        if kind == "walk":
            walk, used, cuts = more
            done = walk.go(lambda si, lo, hi: self.window(s, si, lo, hi), self.n, (first, first + self.part.n), used, cuts, self.profile, self.drift)
            return done, walk
        if kind == "time":
            return float(self.part.ts[asked[1] - first])
        if kind == "spot":
            return float(frame_sims(s, k, self.part, asked[2] - first, asked[2] - first + 1)[0])
        if kind == "detail":
            return frame_detail(s, k, self.part, asked[2] - first)
        if kind == "best":
            sims = frame_sims(s, k, self.part, a, b)
            at = int(sims.argmax())
            return self.lo + at, float(sims[at])
        sims = best_sims(s, k, self.part, asked[2], a, b)
        return sims if kind == "sims" else all_leaders(sims, self.lo, *asked[3:])


class Partly:
    """What an aligner asks of a movie, of which only some answers are ``known``;
    what lacks is noted in ``needs``."""

    def __init__(self, n: int, floors: tuple, known: dict[tuple, object], sims: dict[tuple, np.ndarray]):
        self.n, self.floors, self.known, self.arrays = n, floors, known, sims
        self.needs: dict[tuple, tuple | None] = {}

    def _asked(self, asked: tuple, more: tuple | None = None) -> object:
        if asked not in self.known:
            self.needs[asked] = more
            raise Missing
        return self.known[asked]

    def sims(self, si: int, full_only: bool) -> np.ndarray:
        asked = ("sims", si, full_only)
        if asked not in self.arrays:
            self.needs[asked] = None
            raise Missing
        return self.arrays[asked]

    def swept(self, key: tuple, sweep) -> list:
        """Similarities with a whole movie are held in the round that brings
        them, and what a sweep makes of them is kept."""
        if ("swept", key) not in self.known:
            self.known["swept", key] = sweep()
        return self.known["swept", key]

    def leaders(self, si: int, full_only: bool, floor: float | None = None, most: int | None = None) -> list[tuple[int, float]]:
        return self._asked(("leaders", si, full_only, self.floors, (most or MOST_LEADERS,)))[self.floors.index(floor)]

    def best(self, si: int) -> tuple[int, float]:
        return self._asked(("best", si))

    def spot(self, si: int, mi: int) -> float:
        return self._asked(("spot", si, mi))

    def walk(self, walk: Walk, used: np.ndarray, cuts: np.ndarray, p: Profile, drift: int) -> list[tuple[int, int, float]]:
        asked = ("walk", *walk.seed, walk.step, walk.forced, used.tobytes())
        done, so_far = self.known.get(asked, (False, walk))
        if not done:
            self.needs[asked] = (so_far, used, cuts)
            raise Missing
        return so_far.got

    def time(self, mi: int) -> float:
        return self._asked(("time", mi))

    def detail(self, si: int, mi: int) -> dict:
        return self._asked(("detail", si, mi))


#: Answers of all ranges, and what a chunk makes of them.
_JOINED = {
    "leaders": lambda asked, parts: [join_leaders([p[k] for p in parts])[: asked[4][0]] for k in range(len(asked[3]))],
    "best": lambda asked, parts: max(parts, key=lambda x: (x[1], -x[0])),
    "sims": lambda asked, parts: np.concatenate(parts),
}


def place_of(asked: tuple, more: tuple | None, n: int) -> int:
    """The movie frame where something is asked for."""
    at = more[0].expected() if asked[0] == "walk" else asked[1] if asked[0] == "time" else asked[2]
    return min(n - 1, max(0, at))


def pages_of(movie: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(movie_id, page, first, frames, block): pages, packed in the layout of the first
    frame of their movie; and (movie_id, n, pages, firsts) for each movie.

    ``movie`` has ``movie_id``.  A page is a slot of frame numbers; ``first`` is
    the place of its first frame.  Color motion of a page's first frame comes
    from the last frame of the page before.
    """
    rows = movie.select("movie_id", F.floor(F.col("si") / PAGE).cast("long").alias("page"), *_FEATURES)
    lead_words = F.get("variants", F.lit(0))
    words = F.struct(*[F.greatest(F.coalesce(F.size(lead_words[c]), F.lit(0)), F.lit(0)).alias(c) for c in ("a", "d", "p", "fa", "fd")])
    layout = F.struct(F.transform("variants", lambda v: v["name"]).alias("names"), words.alias("words"))
    colored = F.min(F.coalesce(F.size("color") == 48, F.lit(False)).cast("int"))
    about = rows.groupBy("movie_id", "page").agg(F.count("*").alias("n"), colored.alias("colored"), F.max_by("color", "si").alias("last"), F.min_by(layout, "si").alias("layout"), F.min("si").alias("least"))
    about = tables.write(about)
    # A row for each page: small beside its frames.
    w = Window.partitionBy("movie_id").orderBy("page")
    whole = about.groupBy("movie_id").agg(F.sum("n").alias("total"), F.min("colored").alias("all_colored"), F.min_by("layout", "least").alias("layout"))
    about = about.select("movie_id", "page", (F.sum("n").over(w) - F.col("n")).alias("first"), F.lag("last").over(w).alias("before")).join(whole, "movie_id")
    header = about.groupBy("movie_id").agg(F.first("total").alias("n"), F.sort_array(F.collect_list(F.struct("page", "first"))).alias("p"))
    header = tables.write(header.select("movie_id", "n", F.col("p.page").alias("pages"), F.col("p.first").alias("firsts")))

    def pack(key: tuple, mine: pa.Table, known: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({"movie_id": pa.array([], pa.string()), "page": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "frames": pa.array([], pa.int64()), "block": pa.array([], pa.binary())})
        a = known.slice(0, 1).to_pylist()[0]
        part = Frames.from_arrow(mine, Layout(a["layout"]["names"], {c: n for c, n in a["layout"]["words"].items() if n}))
        part.delta, part.mag = np.zeros((part.n, 48)), np.full(part.n, np.nan)
        if a["all_colored"] and a["total"] > 1:
            before = part.color[:1] if a["before"] is None else np.array([a["before"]], float)
            part.delta = np.diff(np.concatenate((before, part.color)), axis=0)
            part.mag = np.sqrt((part.delta**2).sum(axis=1))
            if a["first"] == 0:
                part.mag[0] = np.nan
        return pa.table({"movie_id": pa.array([a["movie_id"]]), "page": pa.array([a["page"]], pa.int64()), "first": pa.array([a["first"]], pa.int64()), "frames": pa.array([part.n], pa.int64()), "block": pa.array([pickle.dumps(part, 5)])})

    packed = rows.groupBy("movie_id", "page").cogroup(about.groupBy("movie_id", "page")).applyInArrow(pack, "movie_id string, page long, first long, frames long, block binary")
    return tables.write(packed), header


def spans_of(header: DataFrame) -> DataFrame:
    """(movie_id, range, lo, hi, n): ranges, by the places of their first frame
    and of that after the last."""
    pages = header.select("movie_id", "n", F.explode(F.arrays_zip("pages", "firsts")).alias("p"))
    spans = pages.groupBy("movie_id", "n", F.floor(F.col("p.pages") / RANGE_PAGES).cast("long").alias("range")).agg(F.min("p.firsts").alias("lo"))
    return spans.withColumn("hi", F.coalesce(F.lead("lo").over(Window.partitionBy("movie_id").orderBy("range")), "n"))


def answers(held: DataFrame, asked: DataFrame, groups: int, profile: Profile, drift: int) -> DataFrame:
    """What ranges say.  The pages of a range meet what is asked of it in one task
    (or in one for each group of chunks), which holds the range and a margin, and
    streams questions and answers.  ``held``: pages with the range (range, lo, hi,
    n) that they are part of."""
    none = lambda kind: F.lit(None).cast(kind)
    at = ["movie_id", "range", "salt"]
    pages = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*at, F.lit(0).alias("kind"), "first", "lo", "hi", "n", "block", none("string").alias("short_id"), none("long").alias("chunk_id"))
    salt = F.pmod(F.xxhash64("short_id", "chunk_id"), F.lit(groups)).cast("int").alias("salt")
    zero = [F.lit(0).cast("long").alias(c) for c in ("first", "lo", "hi", "n")]
    todo = asked.select("movie_id", F.explode("ranges").alias("range"), salt, F.lit(1).alias("kind"), *zero, F.col("payload").alias("block"), "short_id", "chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, mine = None, [], None
        for batch in batches:
            out, size = [], 0
            for r in (r for k in range(0, batch.num_rows, 64) for r in batch.slice(k, 64).to_pylist()):
                if tuple(r[c] for c in at) != key:
                    key, blocks, mine = tuple(r[c] for c in at), [], None
                if r["kind"] == 0:
                    blocks.append((r["first"], r["block"]))
                    about = r["lo"], r["hi"], r["n"]
                    continue
                if mine is None:
                    mine = Range(Frames.in_a_row([pickle.loads(b) for _, b in sorted(blocks)]), min(blocks)[0], *about, profile, drift)
                    blocks = []
                frames, questions = pickle.loads(r["block"])
                said = pickle.dumps((mine.lo, [(asked, mine.answer(asked, frames, k, more)) for asked, k, more in questions]), 5)
                out.append({"movie_id": r["movie_id"], "short_id": r["short_id"], "chunk_id": r["chunk_id"], "what": _SAID, "ranges": None, "payload": said})
                size += len(said)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=_schema())
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_schema())

    # By cost: little is sent to what computes much, so that tasks are not joined by bytes.
    tasks = _DEALT * held.sparkSession.sparkContext.defaultParallelism
    dealt = pages.unionByName(todo).repartition(tasks, *at).sortWithinPartitions(*at, "kind")
    return dealt.mapInArrow(run, _ROWS)


def resume(said: list[tuple[int, list]], state: dict, profile: Profile, drift: int, min_similarity: float, min_consecutive: int) -> tuple[tuple | None, list[dict]]:
    """Go on with a chunk, with what ranges (by their first place) said: its frames
    and result, or what it still lacks.  ``state["known"]`` learns."""
    short, known, n = state["short"], state["known"], state["n"]
    floors = (None, min_similarity - profile.scan_slack, SECOND_PASS - profile.scan_slack)
    parts: dict[tuple, list] = {}
    for _, some in sorted(said, key=lambda x: x[0]):
        for asked, one in some:
            parts.setdefault(asked, []).append(one)
    sims = {asked: _JOINED["sims"](asked, some) for asked, some in parts.items() if asked[0] == "sims"}
    known.update({asked: _JOINED[asked[0]](asked, some) if asked[0] in _JOINED else some[0] for asked, some in parts.items() if asked[0] != "sims"})
    movie = Partly(n, floors, known, sims)
    aligner = Aligner(short, movie, np.append(state["cuts"], True), profile, drift)
    try:
        return (short, aligner.whole_chunk(min_similarity, min_consecutive)), []
    except Missing:
        pass
    # What goes to all ranges, and what goes to one.
    numbers, starts = state["numbers"], state["starts"]
    groups: dict[tuple, list] = {}
    for asked, more in movie.needs.items():
        to = tuple(numbers) if asked[0] in _JOINED else (numbers[int(np.searchsorted(starts, place_of(asked, more, n), side="right")) - 1],)
        groups.setdefault((to, asked[0] == "walk"), []).append((asked, more))
    out = []
    for (to, walks), some in groups.items():
        rows = sorted({asked[1] for asked, _ in some if asked[0] != "time"})
        place = {si: k for k, si in enumerate(rows)}
        frames = short if walks else some_frames(short, rows) if rows else None
        out.append({"ranges": list(to), "payload": pickle.dumps((frames, [(asked, place.get(asked[1], 0), more) for asked, more in some]), 5)})
    return None, out


def align_ranges(chunks: DataFrame, movie: DataFrame, profile: Profile, min_similarity: float, min_consecutive: int, drift: int) -> DataFrame:
    """(movie_id, short_id, chunk_id, payload): the pickled result of each chunk
    of ``chunks`` (frames with video_id, chunk_id, is_cut, t_delta, t_mag,
    layout) with each movie of ``movie`` (frames with movie_id).

    Runs a job for each part of a round.  Tables of the rounds are removed;
    that of the results stays in the shared folder.
    """
    spark = chunks.sparkSession
    tables, kept = Tables(spark), Tables(spark)
    margin = max(MARGIN, 4 * (profile.widest + drift))
    try:
        pages, header = pages_of(movie, tables)
        spans = tables.write(spans_of(header))
        inside = (F.col("first") < F.col("hi") + margin) & (F.col("first") + F.col("frames") > F.col("lo") - margin)
        held = tables.write(pages.join(spans.withColumnRenamed("movie_id", "_m"), (F.col("movie_id") == F.col("_m")) & inside).drop("_m"))
        groups = max(1, min(16, math.ceil(_DEALT * spark.sparkContext.defaultParallelism / max(1, spans.count()))))
        key = ["movie_id", "short_id", "chunk_id"]
        args = (profile, drift, min_similarity, min_consecutive)

        def go_on(mine: pa.Table) -> pa.Table:
            rows = mine.to_pylist()
            state = next(pickle.loads(r["payload"]) for r in rows if r["what"] == _STATE)
            result, needs = resume([pickle.loads(r["payload"]) for r in rows if r["what"] == _SAID], state, *args)
            if result is not None:
                out = [{"what": _DONE, "ranges": None, "payload": pickle.dumps(result, 5)}]
            else:
                out = [{"what": _STATE, "ranges": None, "payload": pickle.dumps(state, 5)}, *[{"what": _ASKED} | r for r in needs]]
            return pa.Table.from_pylist([{c: rows[0][c] for c in key} | r for r in out], schema=_schema())

        todo = _states(chunks, spans)
        tasks = 2 * spark.sparkContext.defaultParallelism
        results: list[DataFrame] = []
        for _ in range(MOST_ROUNDS):
            got = tables.write(todo.repartition(tasks, *key).groupBy(*key).applyInArrow(go_on, _ROWS))
            results.append(got.filter(F.col("what") == _DONE))
            if got.filter(F.col("what") == _STATE).isEmpty():
                break
            said = tables.write(answers(held, got.filter(F.col("what") == _ASKED), groups, profile, drift))
            todo = got.filter(F.col("what") == _STATE).unionByName(said)
        else:
            raise RuntimeError(f"chunks still open after {MOST_ROUNDS} rounds")
        found = results[0]
        for r in results[1:]:
            found = found.unionByName(r)
        return kept.write(found.select(*key, "payload"))
    finally:
        tables.drop()


def _schema() -> pa.Schema:
    return pa.schema([("movie_id", pa.string()), ("short_id", pa.string()), ("chunk_id", pa.int64()), ("what", pa.string()), ("ranges", pa.list_(pa.int64())), ("payload", pa.binary())])


def _states(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """A row for each chunk and movie with what a chunk starts from."""

    def pack(mine: pa.Table) -> pa.Table:
        mine = mine.sort_by([("si", "ascending")])
        found = mine["layout"][0].as_py()
        short = Frames.from_arrow(mine, Layout(found["names"], {c: n for c, n in found["words"].items() if n}))
        state = pickle.dumps((short, mine["is_cut"].to_numpy()), 5)
        return pa.table({"short_id": pa.array([mine["video_id"][0].as_py()]), "chunk_id": pa.array([mine["chunk_id"][0].as_py()], pa.int64()), "chunk": pa.array([state], pa.binary())})

    packed = chunks.groupBy("video_id", "chunk_id").applyInArrow(pack, "short_id string, chunk_id long, chunk binary")
    # Each chunk meets each movie: movies, of which only ranges are told, are dealt to a few groups of chunks.
    groups = 16
    salt = F.pmod(F.xxhash64("short_id", "chunk_id"), F.lit(groups)).cast("int").alias("salt")
    movies = spans.groupBy("movie_id", "n").agg(F.sort_array(F.collect_list(F.struct("range", "lo"))).alias("r")).select("movie_id", "n", F.col("r.range").alias("numbers"), F.col("r.lo").alias("starts"))
    movies = movies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = packed.withColumn("salt", salt).join(movies, "salt").select("movie_id", "short_id", "chunk_id", "n", "numbers", "starts", "chunk")

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                short, cuts = pickle.loads(r["chunk"])
                about = {"short": short, "cuts": cuts, "n": r["n"], "numbers": r["numbers"], "starts": np.array(r["starts"]), "known": {}}
                out.append({"movie_id": r["movie_id"], "short_id": r["short_id"], "chunk_id": r["chunk_id"], "what": _STATE, "ranges": None, "payload": pickle.dumps(about, 5)})
            yield pa.RecordBatch.from_pylist(out, schema=_schema())

    return both.mapInArrow(state, _ROWS)
