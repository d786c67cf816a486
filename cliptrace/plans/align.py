"""Alignment of one chunk of short frames with a movie, over numpy arrays.

This is the part of matching that is sequential by nature: each step of a walk
depends on the slope of the steps before.  Chunks do not depend on each other,
so that the plan runs one aligner for each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.blocks import Frames, best_sims, frame_detail, frame_sims
from ..operators.scan import SEPARATION, SLOPES


@dataclass(frozen=True)
class Profile:
    """Limits of a search."""

    window: int  # half of the window of a walk at first
    widest: int
    walk_min: float
    walk_floor: float
    misses: int
    walked: int  # seed candidates that are walked
    alternates: int
    dense_seeds: bool
    all_variants: bool  # scan over all pairs of variants
    scan_slack: float  # below the pass's limit: scan floor, top gate, seed gate
    top_slack: float
    seed_slack: float
    forced_gate: float
    rescue: bool  # consensus, sweep and guaranteed pool


# The two sets of limits.
MAIN = Profile(7, 18, 50.0, 40.0, 12, 8, 10, False, False, 20.0, 18.0, 0.0, 65.0, False)
CANDIDATE = Profile(12, 40, 45.0, 32.0, 20, 20, 24, True, True, 30.0, 28.0, 8.0, 55.0, True)
SECOND_PASS = 40.0
LOOK_AHEAD = 25
SLOPE = (0.1, 8.0)
FORCED_FRAMES = 10
RESCUE_MEAN = 32.0
CONSENSUS_STEP, CONSENSUS_BUCKET, CONSENSUS_VOTES, CONSENSUS_TOP = 2, 8, 10, 20
SWEEP_STEP, SWEEP_PROBES, SWEEP_PER_SLOPE, SWEEP_TOP = 4, 12, 4, 12


def js_round(x: float) -> int:
    """Round half up."""
    return int(np.floor(x + 0.5))


class Missing(Exception):
    """What an aligner asks for is not at hand yet."""


def maxima(sims: np.ndarray, floor: float | None = None, step: int = 1) -> list[tuple[int, float]]:
    """Leaders of neighbourhoods, best first."""
    kept: list[list] = []
    for k, s in enumerate(sims.tolist()):
        if s != s or floor is not None and s < floor:
            continue
        lead(kept, k * step, s)
    return sorted(((m, s) for m, s in kept), key=lambda x: -x[1])


def lead(kept: list[list], mi: int, sim: float) -> None:
    """The next frame of a scan: it moves the last leader or is a new one."""
    if kept and mi - kept[-1][0] < SEPARATION:
        if sim > kept[-1][1]:
            kept[-1] = [mi, sim]
    else:
        kept.append([mi, sim])


def slope_of(points: list[tuple[int, int]]) -> float:
    """Movie frames a short frame, from the first to the last of some points."""
    if len(points) < 4:
        return 1.0
    low, high = min(points), max(points)
    if high[0] - low[0] < 3:
        return 1.0
    return min(SLOPE[1], max(SLOPE[0], (high[1] - low[1]) / (high[0] - low[0])))


class Walk:
    """A walk from a seed in one direction, and how far it has come.  A forced
    walk maps every frame of the chunk; only good ones steer it."""

    def __init__(self, seed: tuple[int, int], step: int, chunk: tuple[int, int], forced: bool):
        self.seed, self.step, self.chunk, self.forced = seed, step, chunk, forced
        self.si, self.last, self.slope, self.missed = seed[0] + step, seed, 1.0, 0
        self.got: list[tuple[int, int, float]] = []
        self.steering: list[tuple[int, int]] = []

    def expected(self) -> int:
        return self.last[1] + js_round(self.slope * (self.si - self.last[0]))

    def go(self, window, n: int, held: tuple[int, int], used: np.ndarray, cuts: np.ndarray, p: Profile, drift: int) -> bool:
        """Goes on to its end (true), or to where it needs movie frames that are
        not ``held`` (of ``n``).  ``window``: similarities of a short frame with
        a range of movie frames."""
        while self.chunk[0] <= self.si <= self.chunk[1]:
            si, forced = self.si, self.forced
            if not forced and (used[si] or cuts[si if self.step > 0 else si + 1]):
                break
            expected = self.expected()
            half = p.widest + drift if forced else min(p.widest, p.window + drift + self.missed)
            lo, hi = max(0, expected - half), min(n - 1, expected + half)
            if lo > hi:
                if not forced:
                    break
                self.got.append((si, min(n - 1, max(0, expected)), 0.0))
                self.si += self.step
                continue
            if lo < held[0] or hi >= held[1]:
                return False
            sims = window(si, lo, hi + 1)
            at = int(sims.argmax())
            sim, mi = float(sims[at]), lo + at
            enough = p.walk_min if forced else max(p.walk_floor, p.walk_min - len(self.got) // 25)
            good = sim >= enough and sim > 0
            if good:
                self.steering = [*self.steering[1 - LOOK_AHEAD :], (si, mi)]
                self.last, self.missed = (si, mi), 0
                self.slope = slope_of([self.seed, *self.steering])
            if good or forced:
                self.got.append((si, mi, max(sim, 0.0)))
            else:
                self.missed += 1
                if self.missed >= p.misses:
                    break
            self.si += self.step
        return True


class Whole:
    """What an aligner asks of a movie, with the whole movie at hand."""

    def __init__(self, short: Frames, movie: Frames):
        self.s, self.m, self.n = short, movie, movie.n
        self.last: tuple[tuple[int, bool] | None, np.ndarray] = (None, np.zeros(0))
        self.seen: dict[tuple[int, int, int], np.ndarray] = {}

    def sims(self, si: int, full_only: bool) -> np.ndarray:
        """Hash similarities of a short frame with all movie frames."""
        if self.last[0] != (si, full_only):
            self.last = ((si, full_only), best_sims(self.s, si, self.m, full_only))
        return self.last[1]

    def leaders(self, si: int, full_only: bool, floor: float | None = None, most: int | None = None) -> list[tuple[int, float]]:
        """Leaders of the scan of a short frame, best first; ``most``: how many
        of them are looked at."""
        return maxima(self.sims(si, full_only), floor)[:most]

    def best(self, si: int) -> tuple[int, float]:
        """The movie frame that is most like a short frame."""
        sims = frame_sims(self.s, si, self.m, 0, self.n)
        at = int(sims.argmax())
        return at, float(sims[at])

    def spot(self, si: int, mi: int) -> float:
        """Similarity with one movie frame."""
        return float(frame_sims(self.s, si, self.m, mi, mi + 1)[0])

    def walk(self, walk: Walk, used: np.ndarray, cuts: np.ndarray, p: Profile, drift: int) -> list[tuple[int, int, float]]:
        """The steps of a walk."""
        walk.go(self.window, self.n, (0, self.n), used, cuts, p, drift)
        return walk.got

    def window(self, si: int, lo: int, hi: int) -> np.ndarray:
        """Similarities of a frame of a walk, which walks on the same way ask for again."""
        at = si, lo, hi
        if at not in self.seen:
            self.seen[at] = frame_sims(self.s, si, self.m, lo, hi)
        return self.seen[at]

    def swept(self, key: tuple, sweep) -> list:
        """What a sweep finds."""
        return sweep()

    def time(self, mi: int) -> float:
        return float(self.m.ts[mi])

    def detail(self, si: int, mi: int) -> dict:
        return frame_detail(self.s, si, self.m, mi)


def least_frames(profile: Profile, min_consecutive: int) -> int:
    """Frames that a chunk must have for anything to be found in it: a sequence has no
    more steps than its chunk has frames, and needs so many.  Alternates are offered
    without such a sequence where there is a rescue."""
    return 1 if profile.rescue else min(min_consecutive, 3)


class Aligner:
    """Aligns chunks of ``short`` with a movie."""

    def __init__(self, short: Frames, movie: Frames | Whole, cuts: np.ndarray, profile: Profile, drift: int):
        self.s, self.cuts, self.p, self.drift = short, cuts, profile, drift
        self.m = Whole(short, movie) if isinstance(movie, Frames) else movie
        self.known: dict[tuple, list[tuple[int, int, float]]] = {}  # sequences, by seed and used frames

    def each(self, of, places) -> list:
        """``of`` of each place; what is missing for any of them is asked for
        at once."""
        out, missing = [], False
        for x in places:
            try:
                out.append(of(x))
            except Missing:
                missing = True
        if missing:
            raise Missing
        return out

    # Walks.

    def sequence(self, si: int, mi: int, used: np.ndarray, chunk: tuple[int, int], forced: bool = False, sim: float | None = None) -> list[tuple[int, int, float]]:
        """Both walks from a seed, with short gaps filled."""
        key = (si, mi, forced, used[chunk[0] : chunk[1] + 1].tobytes())
        if key in self.known:
            return self.known[key]
        walk = lambda step: self.m.walk(Walk((si, mi), step, chunk, forced), used, self.cuts, self.p, self.drift)
        back, sim, ahead = self.each(lambda f: f(), (lambda: walk(-1), lambda: self.m.spot(si, mi) if sim is None else sim, lambda: walk(1)))
        points = [*back[::-1], (si, mi, sim), *ahead]
        out = [points[0]]
        for a, b in zip(points, points[1:], strict=False):
            gap = b[0] - a[0]
            if 2 <= gap <= 3:
                out += [(a[0] + k, js_round(a[1] + k / gap * (b[1] - a[1])), (a[2] + b[2]) / 2) for k in range(1, gap)]
            out.append(b)
        self.known[key] = out
        return out

    # Candidate places.

    def seeds(self, chunk: tuple[int, int]) -> list[int]:
        start, end = chunk
        size = end - start + 1
        places = [start + js_round(k * (size - 1) / 4) for k in range(5)]
        if self.p.dense_seeds:
            places += range(start, end + 1, max(10, -(-size // 25)))
        return list(dict.fromkeys(places))

    def consensus(self, chunk: tuple[int, int]) -> list[dict]:
        """Offsets that many probes vote for."""
        votes: dict[int, dict] = {}
        probes = range(chunk[0], chunk[1] + 1, CONSENSUS_STEP)
        for si, found in zip(probes, self.each(lambda si: self.m.leaders(si, False, most=CONSENSUS_VOTES), probes), strict=True):
            for mi, sim in found:
                b = votes.setdefault(js_round((mi - si) / CONSENSUS_BUCKET), {"votes": 0, "sum": 0.0, "sim": -1.0})
                b["votes"] += 1
                b["sum"] += sim
                if sim > b["sim"]:
                    b |= {"sim": sim, "si": si, "mi": mi}
        return sorted(votes.values(), key=lambda b: (-b["votes"], -b["sum"]))[:CONSENSUS_TOP]

    def sweep(self, chunk: tuple[int, int]) -> list[tuple[int, int, float]]:
        """(mid, anchor, score) of playback speeds other than 1."""
        start, end = chunk
        size, mid = end - start + 1, js_round((start + end) / 2)
        probes = list(range(start, end + 1, max(1, size // SWEEP_PROBES)))
        if len(probes) < 2:
            return []

        def of_all_speeds() -> list[tuple[int, float]]:
            sims = self.each(lambda si: self.m.sims(si, True), probes)
            anchors, found = np.arange(0, self.m.n, SWEEP_STEP), []
            for slope in SLOPES:
                total, n = np.zeros(len(anchors)), np.zeros(len(anchors), int)
                for row, si in zip(sims, probes, strict=True):
                    mi = np.floor(anchors + slope * (si - mid) + 0.5).astype(int)
                    ok = (mi >= 0) & (mi < self.m.n)
                    total[ok] += row[mi[ok]]
                    n += ok
                score = np.where(n >= max(2, len(probes) // 2), total / np.maximum(n, 1), np.nan)
                found += maxima(score, step=SWEEP_STEP)[:SWEEP_PER_SLOPE]
            return found

        found = self.m.swept(tuple(probes), of_all_speeds)
        blended = self.each(lambda x: (mid, x[0], 0.5 * x[1] + 0.5 * self.m.spot(mid, x[0])), found)
        return sorted(blended, key=lambda x: -x[2])[:SWEEP_TOP]

    # One chunk.

    def chunk(self, chunk: tuple[int, int], min_similarity: float, min_consecutive: int) -> tuple[list[dict], list[dict]]:
        """Segments and alternates of a chunk; both are dicts with ``seq``."""
        start, end = chunk
        size = end - start + 1
        if size < least_frames(self.p, min_consecutive):
            return [], []
        used = np.zeros(self.s.n + 1, bool)
        least = min(min_consecutive, max(3, int(size * 0.4)))
        segments, pool = [], []

        def better(seq, best):
            if len(seq) < least:
                return best
            mean = sum(x[2] for x in seq) / len(seq)
            return (seq, mean) if best is None or (len(seq), mean) > (len(best[0]), best[1]) else best

        def accept(seq, approximate: bool, stage: str) -> None:
            used[[x[0] for x in seq]] = True
            segments.append({"seq": seq, "approximate": approximate, "stage": stage})

        def offer(raw: list[tuple[int, float]]) -> None:
            kept: list[int] = []
            for offset, _ in sorted(raw, key=lambda x: -x[1]):
                if all(abs(offset - k) >= SEPARATION for k in kept):
                    kept.append(offset)
                if len(kept) >= self.p.alternates:
                    break
            mid = js_round((start + end) / 2)
            places = [min(self.m.n - 1, max(0, offset + mid)) for offset in kept]
            for seq in self.each(lambda mi: self.sequence(mid, mi, used, chunk, forced=True), places):
                pool.append({"seq": seq, "approximate": True, "stage": "pool"})

        left = lambda: [si for si in range(start, end + 1) if not used[si]]
        for number, limit in ((1, min_similarity), (2, SECOND_PASS)):
            if not left():
                break
            best, raw = None, []

            def tried(place: int, limit: float = limit) -> tuple[list, list]:
                """Offsets that a seed offers, and the sequences it leads to."""
                si = place
                if used[si]:
                    free = sorted(left(), key=lambda x: (abs(x - place), x < place))
                    if not free:
                        return [], []
                    si = free[0]
                full = not self.p.all_variants
                most = max(self.p.alternates + 4, self.p.walked)
                offers = [(mi - si, s) for mi, s in self.m.leaders(si, full, most=most)[: self.p.alternates + 4]]
                found = self.m.leaders(si, full, limit - self.p.scan_slack, most)[: self.p.walked]
                if not found or found[0][1] < limit - self.p.top_slack:
                    return offers, []
                sims = self.each(lambda x: self.m.spot(si, x[0]), found)
                good = [(mi, sim) for (mi, _), sim in zip(found, sims, strict=True) if sim >= limit - self.p.seed_slack]
                return offers, self.each(lambda x: self.sequence(si, x[0], used, chunk, sim=x[1]), good)

            for offers, sequences in self.each(tried, self.seeds(chunk)):
                raw += offers
                for seq in sequences:
                    best = better(seq, best)
            if best:
                accept(best[0], number == 2, f"pass{number}")
            if best or self.p.rescue and number == 2:
                offer(raw)
        if self.p.rescue and size >= 3:
            if left():
                found = self.consensus(chunk)
                best = None
                for seq in self.each(lambda b: self.sequence(b["si"], b["mi"], used, chunk), found):
                    if sum(x[2] for x in seq) / len(seq) >= RESCUE_MEAN:
                        best = better(seq, best)
                if best:
                    accept(best[0], True, "consensus")
                if found:
                    offer([(b["mi"] - b["si"], b["sum"] / b["votes"]) for b in found])
            if left():
                found = self.sweep(chunk)
                best = None
                for seq in self.each(lambda x: self.sequence(x[0], min(self.m.n - 1, max(0, x[1])), used, chunk), found):
                    if sum(x[2] for x in seq) / len(seq) >= RESCUE_MEAN:
                        best = better(seq, best)
                if best:
                    accept(best[0], True, "sweep")
                if found:
                    offer([(a - mid, s) for mid, a, s in found])
        rest = left()
        if len(rest) >= FORCED_FRAMES:
            forced = [(si, at, sim) if sim > 0 else (si, 0, 0.0) for si, (at, sim) in zip(rest, self.each(self.m.best, rest), strict=True)]
            if sum(x[2] for x in forced) / len(forced) >= self.p.forced_gate:
                group = [forced[0]]
                for a, b in zip(forced, forced[1:], strict=False):
                    if abs(b[1] - (a[1] + b[0] - a[0])) <= 2 * LOOK_AHEAD:
                        group.append(b)
                    else:
                        accept(group, True, "forced")
                        group = [b]
                accept(group, True, "forced")
        if self.p.rescue and left():
            probes = list(dict.fromkeys([start, js_round((start + end) / 2), end]))
            found = self.each(lambda si: self.m.leaders(si, False), probes)
            offer([(mi - si, s) for si, places in zip(probes, found, strict=True) for mi, s in places])
        return segments, pool

    def whole_chunk(self, min_similarity: float, min_consecutive: int) -> list[tuple]:
        """(kind, number, found, summary, steps) of all segments, then all
        alternates, of the short taken as one chunk."""
        segments, pool = self.chunk((0, self.s.n - 1), min_similarity, min_consecutive)
        found = [(kind, k, x) for kind, some in (("segment", segments), ("alternate", pool)) for k, x in enumerate(some)]
        return self.each(lambda x: (*x, self.summary(x[2]["seq"]), self.steps(x[2]["seq"])), found)

    def steps(self, seq: list[tuple[int, int, float]]) -> list[dict]:
        """Times and similarity of each step of a sequence."""
        times = self.each(lambda x: self.m.time(x[1]), seq)
        return [{"short_time": float(self.s.ts[a]), "movie_time": t, "similarity": float(c), "si": int(self.s.si[a]), "mi": int(b)} for (a, b, c), t in zip(seq, times, strict=True)]

    def summary(self, seq: list[tuple[int, int, float]]) -> dict:
        """Times, speed, and the best frame of a sequence with its detail."""
        si, mi, sim = (np.array(x) for x in zip(*seq, strict=True))
        slope = 1.0
        if len(seq) >= 2 and si.max() > si.min():
            d = si - si.mean()
            slope = float((d * (mi - mi.mean())).sum() / (d * d).sum())
        slope = min(SLOPE[1], max(SLOPE[0], slope))
        by_line = int(mi[0]) + js_round(slope * int(si[-1] - si[0]))
        end = min(self.m.n - 1, max(0, by_line)) if abs(by_line - int(mi[-1])) > 1 else int(mi[-1])
        top = int(sim.argmax())
        first, last, detail = self.each(lambda f: f(), (lambda: self.m.time(int(mi[0])), lambda: self.m.time(end), lambda: self.m.detail(int(si[top]), int(mi[top]))))
        return {
            "short_start": float(self.s.ts[si[0]]), "short_end": float(self.s.ts[si[-1]]),
            "movie_start": first, "movie_end": last,
            "confidence": float(sim.mean()), "frame_count": len(seq),
            "gap_count": int(si[-1] - si[0] + 1 - len(set(si.tolist()))) if len(seq) > 1 else 0,
            "speed_ratio": slope, "best_si": int(si[top]), "best_mi": int(mi[top]), "detail": detail,
        }
