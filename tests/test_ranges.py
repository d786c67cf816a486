"""Matching over movie ranges: the same rows as with the whole movie at hand."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptrace.functions.blocks import Frames
from cliptrace.operators.scan import SEPARATION
from cliptrace.plans import match as plan
from cliptrace.plans import ranges
from cliptrace.plans.align import CANDIDATE, MAIN, maxima

from .test_matching import FRAME, colored, edited, rows


@pytest.mark.parametrize("kind", ["noise", "steps", "equal", "falling", "rising"])
def test_leaders_of_ranges_join_to_those_of_the_whole(kind):
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 700)
        make = {"noise": lambda k: rng.random(), "steps": lambda k: float(rng.randint(0, 3)), "equal": lambda k: 1.0, "falling": lambda k: -k / 7, "rising": lambda k: k / 7}[kind]
        sims = np.array([make(k) for k in range(n)])
        for floor in (None, float(np.median(sims)), float(sims.max()) + 1):
            cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 6)))) if n > 1 else []
            parts = [ranges.range_leaders(sims[a:b], a, floor) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
            assert ranges.join_leaders(parts) == maxima(sims, floor)


def test_noise_needs_few_open_frames():
    sims = np.random.default_rng(1).random(4_096)
    open_part, leaders = ranges.range_leaders(sims, 4_096, None)
    assert len(open_part) < 8 * SEPARATION and len(leaders) > 40


def made(spark, rng, n):
    movie = [f | {"ts": k / 25} for k, f in enumerate(colored(rng, n, 35))]
    shorts = {
        "a": edited(rng, movie, [(20, 24, 1), (n - 90, 18, 2), (None, 14, 1), (60, 16, 1)], 25),
        "b": edited(rng, movie, [(n // 2, 20, 0.5), (5, 12, 1)], 10, turned=True),
        "c": [{**f, "color": None, "skin": None, "detail": None} for f in edited(rng, movie, [(90, 15, 1), (None, 12, 1), (40, 5, 1)], 30)],
    }
    of = lambda name, video: [(name, k, f["ts"], [tuple(v[c] for c in ("name", "a", "d", "fa", "fd", "p")) for v in f["variants"]], f["color"], f["skin"], f["detail"]) for k, f in enumerate(video)]
    return spark.createDataFrame([r for n, v in shorts.items() for r in of(n, v)], FRAME), spark.createDataFrame(of("m", movie), FRAME)


def rounded(x):
    """Products over blocks of other lengths may differ in the last bit."""
    if isinstance(x, float):
        return round(x, 9)
    return {k: rounded(v) for k, v in x.items()} if isinstance(x, dict) else [rounded(v) for v in x] if isinstance(x, list) else x


def everything(got):
    flat = lambda df: sorted(repr(rounded(r.asDict(True))) for r in df.collect())
    return [flat(getattr(got, n)) for n in ("segments", "unmatched", "alternates", "pool")]


@pytest.mark.parametrize(("profile", "pages"), [(MAIN, (1_000, 100, 6)), (CANDIDATE, (100,))], ids=["main", "candidate"])
def test_rows_do_not_depend_on_the_number_of_ranges(spark, monkeypatch, profile, pages):
    """1, 3 and about 50 ranges, and the whole movie."""
    short, movie = made(spark, np.random.default_rng(12), 300)
    want = everything(plan.match(short, movie, profile))
    monkeypatch.setattr(plan, "WHOLE_FRAMES", 0)
    for page in pages:
        monkeypatch.setattr(ranges, "PAGE", page)
        monkeypatch.setattr(ranges, "RANGE_PAGES", 1)
        assert everything(plan.match(short, movie.repartition(4), profile)) == want, page


def test_no_task_holds_the_movie(spark, monkeypatch):
    """Frames of a movie that tasks unpack together stay below a bound, and
    movies of a library with odd frame numbers give what they give whole."""
    short, movie = made(spark, np.random.default_rng(5), 260)
    two = movie.withColumns({"video_id": F.lit("n"), "si": F.col("si") * 3 + 1_000}).unionByName(movie)
    want = everything(plan.match(short, two, MAIN, single=False))
    monkeypatch.setattr(plan, "WHOLE_FRAMES", 100)
    monkeypatch.setattr(ranges, "PAGE", 40)
    monkeypatch.setattr(ranges, "RANGE_PAGES", 2)
    joined = Frames.in_a_row.__func__

    def bounded(cls, parts):
        if sum(p.n for p in parts) > 80:
            raise AssertionError("more than a range in one task")
        return joined(cls, parts)

    monkeypatch.setattr(Frames, "in_a_row", classmethod(bounded))
    assert everything(plan.match(short, two, MAIN, single=False)) == want
    # Copies of pages do not grow with the shorts: a scan ships each page once.
    from cliptrace.shared import Tables

    tables = Tables(spark)
    pages, header = ranges.pages_of(two.withColumn("movie_id", F.col("video_id")), tables)
    assert pages.count() == sum(len(r["pages"]) for r in header.collect()) and {r["n"] for r in header.collect()} == {260}
    tables.drop()


def test_empty_sides(spark, monkeypatch):
    monkeypatch.setattr(plan, "WHOLE_FRAMES", -1)
    short = spark.createDataFrame(rows("s", [[0] * 256] * 12), FRAME)
    nothing = spark.createDataFrame([], FRAME)
    assert plan.match(short, nothing, MAIN).segments.count() == 0
    assert plan.match(nothing, short, MAIN).segments.count() == 0
    assert plan.match(short, short.limit(1), CANDIDATE).segments.count() >= 0


def test_blocks_travel_without_what_no_frame_has():
    """A page of frames without grids takes little more than its hashes, and
    comes back as it was."""
    import pickle

    from cliptrace.functions.blocks import CHANNELS, GRIDS, Layout

    rng = np.random.default_rng(2)
    n = ranges.PAGE
    hashes = {c: rng.integers(0, 2**60, (n, 3, 1)).astype(np.uint64) for c in CHANNELS}
    page = Frames(np.arange(n), np.arange(n) / 25, hashes, Layout(["full", "b", "c"], {c: 2 for c in CHANNELS}), {g: (np.zeros((n, w)), np.zeros(n, bool)) for g, w in GRIDS.items()})
    page.delta, page.mag = np.zeros((n, 48)), np.full(n, np.nan)
    sent = pickle.dumps(page, 5)
    assert len(sent) < n * (3 * 5 * 8 + 16) + 4_000
    back = pickle.loads(sent)
    assert back.n == n and (back.hashes["fd"] == hashes["fd"]).all() and back.color.shape == (n, 48) and not back.signed.any()
    assert back.delta.shape == (n, 48) and np.isnan(back.mag).all() and back.moves == page.moves
    page.grids["skin"][1][:] = True
    page.mag[1:], page.delta[3, 5] = 4.0, 4.0
    back = pickle.loads(pickle.dumps(page, 5))
    assert back.has_skin.all() and not back.has_color.any() and back.delta[3, 5] == 4.0 and np.isnan(back.mag[0]) and (back.mag[1:] == 4).all()


def test_floors_that_all_frames_pass_are_gone_through_once(monkeypatch):
    rng = np.random.default_rng(4)
    sims = 50 + 5 * rng.standard_normal(3_000)
    floors, calls, plain = (None, 62.0, 20.0), [], ranges.range_leaders
    monkeypatch.setattr(ranges, "range_leaders", lambda *x: calls.append(x[2]) or plain(*x))
    got = ranges.all_leaders(sims, 4_096, floors)
    assert got == [plain(sims, 4_096, f) for f in floors] and calls == [None, 62.0]
    for n in (1, 2, 48, 49, 50, 700):
        before = [max([-np.inf, *sims[max(0, k - SEPARATION + 1) : k]]) for k in range(n)]
        assert ranges._before(sims[:n], SEPARATION - 1).tolist() == before


def test_a_window_of_a_walk_meets_all_variants_at_once(monkeypatch):
    from cliptrace.functions import blocks
    from cliptrace.functions.blocks import CHANNELS, GRIDS, Layout

    def frames(n, names, seed):
        rng = np.random.default_rng(seed)
        hashes = {c: rng.integers(0, 2**63, (n, len(names), 1)).astype(np.uint64) for c in CHANNELS}
        return Frames(np.arange(n), np.arange(n) / 25, hashes, Layout(names, {c: 2 for c in CHANNELS}), {g: (np.zeros((n, w)), np.zeros(n, bool)) for g, w in GRIDS.items()})

    calls, plain = [], blocks._pair_sims
    monkeypatch.setattr(blocks, "_pair_sims", lambda *x: calls.append(x) or plain(*x))
    for names in (["full", "b", "c"], ["b"], []):
        short, movie = frames(5, names, 1), frames(600, ["full", "b", "c"], 2)
        for lo, hi in ((0, 1), (30, 71), (100, 355), (7, 7)):
            got, n = blocks.hash_sims(short, 3, movie, lo, hi, False), len(calls)
            assert n <= 1
            monkeypatch.setattr(blocks, "FEW", 0)
            assert got.tolist() == blocks.hash_sims(short, 3, movie, lo, hi, False).tolist()
            monkeypatch.undo()
            calls.clear()
            monkeypatch.setattr(blocks, "_pair_sims", lambda *x: calls.append(x) or plain(*x))


@pytest.mark.parametrize("profile", [MAIN, CANDIDATE], ids=["main", "candidate"])
def test_walks_go_to_the_frames_and_rounds_are_few(profile):
    """Ranges of 128 frames: a walk over many of them is sent on at each end, and
    neither what is asked nor what is said grows with the movie's pages."""
    import pickle

    from cliptrace.functions.blocks import CHANNELS, GRIDS, Layout
    from cliptrace.plans.align import Aligner

    rng = np.random.default_rng(7)
    names = ["full", "b", "c"]
    layout = Layout(names, {c: 2 for c in CHANNELS})
    of = lambda hashes, first: Frames(first + np.arange(len(hashes["a"])), np.arange(len(hashes["a"])) / 25, hashes, layout, {g: (np.zeros((len(hashes["a"]), w)), np.zeros(len(hashes["a"]), bool)) for g, w in GRIDS.items()})
    hashes = {c: rng.integers(0, 2**63, (2_048, 3, 1)).astype(np.uint64) for c in CHANNELS}
    movie, short = of(hashes, 0), of({c: x[700:1_000:2] for c, x in hashes.items()}, 0)
    short.delta, short.mag = np.zeros((150, 48)), np.full(150, np.nan)
    cuts, floors = np.zeros(150, bool), (82, 9)
    want = Aligner(short, movie, np.append(cuts, True), profile, 3).whole_chunk(*floors)
    margin, held = 64, []
    for lo in range(0, 2_048, 128):
        a, b = max(0, lo - margin), min(2_048, lo + 128 + margin)
        part = of({c: x[a:b] for c, x in hashes.items()}, a)
        part.ts = movie.ts[a:b]
        part.delta, part.mag = np.zeros((b - a, 48)), np.full(b - a, np.nan)
        held.append(ranges.Range(part, a, lo, lo + 128, 2_048, profile, 3))
    state = {"short": short, "cuts": cuts, "n": 2_048, "numbers": list(range(16)), "starts": np.arange(0, 2_048, 128), "known": {}}
    said, result, sizes = [], None, []
    for _ in range(40):
        result, needs = ranges.resume(said, state, profile, 3, *floors)
        if result is not None:
            break
        state, said = pickle.loads(pickle.dumps(state)), []
        for row in needs:
            for r in row["ranges"]:
                frames, questions = pickle.loads(row["payload"])
                said.append((held[r].lo, [(asked, held[r].answer(asked, frames, k, more)) for asked, k, more in questions]))
        sizes.append((len(pickle.dumps(state)), max(len(pickle.dumps(x)) for x in said)))
    assert result is not None and repr(rounded([list(x) for x in result[1]])) == repr(rounded([list(x) for x in want]))
    assert len(sizes) <= 24  # ranges are a 32nd of what they are by default
    assert max(x for x, _ in sizes) < 400_000 and any("walk" == asked[0] for asked in state["known"])


def test_variants_of_a_scan_are_reduced_by_columns(monkeypatch):
    """Rows of three are slow to reduce: no reduction over the variants of each
    frame, and the same similarities."""
    from cliptrace.functions import blocks
    from cliptrace.functions.blocks import CHANNELS, GRIDS, Layout

    class Pairs(np.ndarray):
        def max(self, *_, **__):
            raise AssertionError("reduced row by row")

    rng = np.random.default_rng(3)
    frames = lambda n: Frames(np.arange(n), np.arange(n) / 25, {c: rng.integers(0, 2**63, (n, 3, 1)).astype(np.uint64) for c in CHANNELS}, Layout(["full", "b", "c"], {c: 2 for c in CHANNELS}), {g: (np.zeros((n, w)), np.zeros(n, bool)) for g, w in GRIDS.items()})
    short, movie = frames(3), frames(3_000)
    plain = blocks._pair_sims
    want = [np.max([plain(short, 1, v, movie, 5, 2_900).max(axis=1) for v in some], axis=0) * 100 for some in ((0,), (0, 1, 2))]
    monkeypatch.setattr(blocks, "_pair_sims", lambda *x: plain(*x).view(Pairs))
    assert (blocks.hash_sims(short, 1, movie, 5, 2_900, True) == want[0]).all()
    assert (blocks.hash_sims(short, 1, movie, 5, 2_900, False) == want[1]).all()


def test_chunks_in_which_nothing_can_be_found_are_not_scanned(spark, monkeypatch):
    """Each frame cuts: no sequence of three frames, and without a rescue no scan."""
    from cliptrace.plans.align import Aligner

    class Scanned(Exception):
        pass

    class Movie:
        n = 1_000

        def leaders(self, *_, **__):
            raise Scanned

    class Short:
        n = 2

    assert Aligner(Short(), Movie(), np.array([True, False, True]), MAIN, 3).whole_chunk(82, 9) == []
    for profile, frames in ((CANDIDATE, 9), (MAIN, 2)):
        with pytest.raises(Scanned):
            Aligner(Short(), Movie(), np.array([True, False, True]), profile, 3).whole_chunk(82, frames)
    short, movie = made(spark, np.random.default_rng(3), 260)
    cut = short.withColumn("color", F.transform("color", lambda x: x + F.when(F.col("si") % 2 == 0, 200).otherwise(0))).filter("video_id <> 'c'")
    seen = []
    monkeypatch.setattr(plan, "WHOLE_FRAMES", 0)
    monkeypatch.setattr(plan, "align_ranges", lambda chunks, *x: seen.append(chunks.count()) or ranges.align_ranges(chunks, *x))
    got = plan.match(cut, movie, MAIN)
    assert got.unmatched.agg(F.sum("frames")).first()[0] == cut.count() and seen == [0]


def test_a_range_goes_through_a_scan_once_and_through_a_walk_once(monkeypatch):
    """Marks of a scan serve all its floors, few frames are told beside leaders, and
    walks on one way compare a frame once."""
    from cliptrace.functions.blocks import CHANNELS, GRIDS, Layout, best_sims, hash_sims
    from cliptrace.plans.align import Walk

    rng = np.random.default_rng(9)
    sims = 50 + 5 * rng.standard_normal(16_384)
    marked, plain = [], ranges.marks
    monkeypatch.setattr(ranges, "marks", lambda x: marked.append(len(x)) or plain(x))
    found = ranges.all_leaders(sims, 16_384, (None, 52.0, 10.0), (28,))
    assert marked == [16_384] and all(len(o) < SEPARATION and len(best) == 29 for o, best in found)

    layout = Layout(["full", "b", "c"], {c: 2 for c in CHANNELS})
    hashes = {c: rng.integers(0, 2**63, (900, 3, 1)).astype(np.uint64) for c in CHANNELS}
    frames = lambda a, b: Frames(np.arange(b - a), np.arange(b - a) / 25, {c: x[a:b] for c, x in hashes.items()}, layout, {g: (rng.random((b - a, w)), np.full(b - a, True)) for g, w in GRIDS.items()})
    movie, short = frames(0, 900), frames(300, 400)
    for full in (True, False):
        assert best_sims(short, 7, movie, full, 3, 890) == pytest.approx(hash_sims(short, 7, movie, 3, 890, full), abs=1e-9)
    calls, sims_of = [], ranges.frame_sims
    monkeypatch.setattr(ranges, "frame_sims", lambda *x: calls.append(x[1]) or sims_of(*x))
    held = ranges.Range(movie, 0, 0, 900, 900, CANDIDATE, 3)
    for seed in range(0, 100, 10):
        done, walk = held.answer(("walk",), short, 0, (Walk((seed, 300 + seed), 1, (0, 99), False), np.zeros(101, bool), np.zeros(101, bool)))
        assert done and [mi for _, mi, _ in walk.got] == list(range(301 + seed, 400))
    assert sorted(calls) == list(range(1, 100))
