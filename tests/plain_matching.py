"""Matching as plain loops over lists, one frame pair at a time: what the plan
is compared with, row by row.  Written from the rules, without its code."""

from __future__ import annotations

import math

LIMITS = {
    # window, widest, walk least, floor, misses, walked, alternates, dense seeds, all variants, scan slack, top slack, seed slack, forced gate, rescue
    "main": (7, 18, 50, 40, 12, 8, 10, False, False, 20, 18, 0, 65, False),
    "candidate": (12, 40, 45, 32, 20, 20, 24, True, True, 30, 28, 8, 55, True),
}


def rnd(x):
    return math.floor(x + 0.5)


def ham(x, y):
    return sum(bin(a ^ b).count("1") for a, b in zip(x, y, strict=True))


def sim_bits(x, y):
    return None if not x or not y or len(x) != len(y) else 1 - ham(x, y) / (32 * len(x))


def pair(s, m):
    a, d, p = (sim_bits(s[c], m[c]) for c in ("a", "d", "p"))
    normal = 0 if a is None else 0.25 * a + 0.35 * d + 0.4 * p if d is not None and p is not None else 0.55 * a + 0.45 * d if d is not None else 0.5 * a + 0.5 * p if p is not None else a
    fa, fd = sim_bits(s["a"], m["fa"]), sim_bits(s["d"], m["fd"])
    flip = 0 if fa is None else fa if fd is None else 0.55 * fa + 0.45 * fd
    return max(normal, flip) * 100


def z(grid):
    out = [0.0] * 48
    for c in range(3):
        v = [grid[i * 3 + c] for i in range(16)]
        mean = sum(v) / 16
        sd = max(8.0, math.sqrt(sum((x - mean) ** 2 for x in v) / 16))
        for i in range(16):
            out[i * 3 + c] = (v[i] - mean) / sd
    return out


def mirror(grid, k):
    return [grid[(r * 4 + 3 - c) * k + j] for r in range(4) for c in range(4) for j in range(k)]


def grids(s, m, turned):
    t = mirror if turned else lambda g, k: g
    color = 1 - sum(abs(x - y) for x, y in zip(z(s["color"]), t(z(m["color"]), 3), strict=True)) / 48 / 2
    skin = 1 - sum(abs(x - y) for x, y in zip(s["skin"], t(m["skin"], 1), strict=True)) / 16
    top = max(1, *s["detail"], *m["detail"])
    detail = 1 - sum(abs(x - y) / top for x, y in zip(s["detail"], t(m["detail"], 1), strict=True)) / 16
    return color, skin, detail


class Match:
    """One short and one movie: lists of frames (ts, variants, color, skin, detail)."""

    def __init__(self, short, movie, profile, least_sim=82, least_frames=9, drift=3):
        self.s, self.m, self.p, self.drift = short, movie, LIMITS[profile], drift
        self.least_sim, self.least_frames = least_sim, least_frames
        self.used = [False] * len(short)
        self.cut = [self.is_cut(i) for i in range(len(short))]
        self.known = {}

    def colored(self, v):
        return len(v) > 1 and all(f["color"] for f in v)

    def motion(self, v, i):
        d = [a - b for a, b in zip(v[i]["color"], v[i - 1]["color"], strict=True)]
        return d, math.sqrt(sum(x * x for x in d))

    def is_cut(self, i):
        if i == 0:
            return False
        x, y = self.s[i - 1]["variants"][0], self.s[i]["variants"][0]
        far = lambda c, least: sim_bits(x[c], y[c]) is not None and sim_bits(x[c], y[c]) * 100 < least
        return far("a", 25) or far("d", 28) or self.colored(self.s) and self.motion(self.s, i)[1] > 100

    def fast(self, si, mi):
        return max(pair(self.s[si]["variants"][0], v) for v in self.m[mi]["variants"])

    def best(self, si, mi):
        return max(pair(u, v) for u in self.s[si]["variants"] for v in self.m[mi]["variants"])

    def frame(self, si, mi):
        if (si, mi) not in self.known:
            self.known[si, mi] = self._frame(si, mi)
        return self.known[si, mi]

    def _frame(self, si, mi):
        h, s, m = self.best(si, mi), self.s[si], self.m[mi]
        if not s["color"] or not m["color"]:
            return h
        plain, turned = ((max(0, c) + k + d) / 3 * 100 for c, k, d in (grids(s, m, False), grids(s, m, True)))
        g, t = max(plain, turned), -1
        if self.colored(self.s) and self.colored(self.m) and si and mi:
            (a, x), (b, y) = self.motion(self.s, si), self.motion(self.m, mi)
            t = 78 if x < 6 and y < 6 else 38 if x < 6 or y < 6 else (sum(p * q for p, q in zip(a, b, strict=True)) / (x * y) + 1) / 2 * 100
        return 0.7 * h + 0.14 * g + 0.16 * t if t >= 0 else 0.84 * h + 0.16 * g

    def slope(self, points):
        if len(points) < 4:
            return 1.0
        lo, hi = min(points), max(points)
        return 1.0 if hi[0] - lo[0] < 3 else min(8, max(0.1, (hi[1] - lo[1]) / (hi[0] - lo[0])))

    def walk(self, seed, d, lo, hi, forced):
        window, widest, least, floor, misses = self.p[:5]
        last_si, last_mi, slope, miss, got, good = seed[0], seed[1], 1.0, 0, [], []
        si = seed[0] + d
        while lo <= si <= hi:
            if not forced and (self.used[si] or self.cut[si if d > 0 else si + 1]):
                break
            e = last_mi + rnd(slope * (si - last_si))
            half = widest + self.drift if forced else min(widest, window + self.drift + miss)
            best = (-1.0 if forced else 0.0, None)
            for mi in range(max(0, e - half), min(len(self.m) - 1, e + half) + 1):
                f = self.frame(si, mi)
                if f > best[0]:
                    best = (f, mi)
            if max(0, e - half) > min(len(self.m) - 1, e + half) and not forced:
                break
            mi = best[1] if best[1] is not None else min(len(self.m) - 1, max(0, e))
            ok = best[1] is not None and best[0] >= (least if forced else max(floor, least - len(got) // 25))
            if ok:
                good.append((si, mi, best[0]))
                last_si, last_mi, miss = si, mi, 0
                slope = self.slope([seed, *good[-25:]])
            if ok or forced:
                got.append((si, mi, max(best[0], 0)))
            else:
                miss += 1
                if miss >= misses:
                    break
            si += d
        return got

    def sequence(self, si, mi, lo, hi, forced=False):
        seed = (si, mi, self.frame(si, mi))
        points = [*self.walk(seed, -1, lo, hi, forced)[::-1], seed, *self.walk(seed, 1, lo, hi, forced)]
        out = points[:1]
        for a, b in zip(points, points[1:], strict=False):
            gap = b[0] - a[0]
            for k in range(1, gap if gap <= 3 else 1):
                out.append((a[0] + k, rnd(a[1] + k / gap * (b[1] - a[1])), (a[2] + b[2]) / 2))
            out.append(b)
        return out

    def leaders(self, sims, floor=None, step=1):
        out = []
        for k, s in sims:
            if floor is not None and s < floor:
                continue
            if out and k - out[-1][0] < 50:
                if s > out[-1][1]:
                    out[-1] = (k, s)
            else:
                out.append((k, s))
        return sorted(out, key=lambda x: -x[1])

    def run(self):
        """Segments and alternates as (seq, approximate)."""
        n = len(self.s)
        starts = [0, *[i for i in range(1, n) if self.cut[i]]]
        self.found, self.pool = [], []
        for lo, nxt in zip(starts, [*starts[1:], n], strict=True):
            self.chunk(lo, nxt - 1)
        return self.found, self.pool

    def accept(self, seq, approximate):
        for x in seq:
            self.used[x[0]] = True
        self.found.append((seq, approximate))

    def offer(self, raw, lo, hi):
        kept = []
        for off, _ in sorted(raw, key=lambda x: -x[1]):
            if all(abs(off - k) >= 50 for k in kept) and len(kept) < self.p[6]:
                kept.append(off)
        mid = rnd((lo + hi) / 2)
        for off in kept:
            self.pool.append((self.sequence(mid, min(len(self.m) - 1, max(0, off + mid)), lo, hi, True), True))

    def chunk(self, lo, hi):
        _, _, _, _, _, walked, alternates, dense, every, scan_slack, top_slack, seed_slack, gate, rescue = self.p
        size, movie = hi - lo + 1, range(len(self.m))
        least = min(self.least_frames, max(3, int(0.4 * size)))
        free = lambda: [i for i in range(lo, hi + 1) if not self.used[i]]

        def better(best, seq):
            mean = sum(x[2] for x in seq) / len(seq)
            return (seq, mean) if len(seq) >= least and (best is None or len(seq) > len(best[0]) or len(seq) == len(best[0]) and mean > best[1]) else best

        for limit in (self.least_sim, 40):
            if not free():
                break
            places = [lo + rnd(k * (size - 1) / 4) for k in range(5)] + (list(range(lo, hi + 1, max(10, math.ceil(size / 25)))) if dense else [])
            best, raw = None, []
            for place in dict.fromkeys(places):
                si = place
                if self.used[si]:
                    around = [x for d in range(1, size + 1) for x in (place + d, place - d) if lo <= x <= hi and not self.used[x]]
                    if not around:
                        continue
                    si = around[0]
                sims = [(mi, (self.best if every else self.fast)(si, mi)) for mi in movie]
                raw += [(mi - si, s) for mi, s in self.leaders(sims)[: alternates + 4]]
                top = self.leaders(sims, limit - scan_slack)[:walked]
                if not top or top[0][1] < limit - top_slack:
                    continue
                for mi, _ in top:
                    if self.frame(si, mi) >= limit - seed_slack:
                        best = better(best, self.sequence(si, mi, lo, hi))
            if best:
                self.accept(best[0], limit == 40)
            if best or rescue and limit == 40:
                self.offer(raw, lo, hi)
        if rescue and size >= 3:
            self.rescue(lo, hi, better, free)
        rest = free()
        if len(rest) >= 10:
            forced = []
            for si in rest:
                mi, s = max(((mi, self.frame(si, mi)) for mi in movie), key=lambda x: (x[1], -x[0]))
                forced.append((si, mi, s))
            if sum(x[2] for x in forced) / len(forced) >= gate:
                group = forced[:1]
                for a, b in zip(forced, forced[1:], strict=False):
                    if abs(b[1] - (a[1] + b[0] - a[0])) > 50:
                        self.accept(group, True)
                        group = []
                    group.append(b)
                self.accept(group, True)
        if rescue and free():
            raw = []
            for si in dict.fromkeys([lo, rnd((lo + hi) / 2), hi]):
                raw += [(mi - si, s) for mi, s in self.leaders([(mi, self.best(si, mi)) for mi in movie])]
            self.offer(raw, lo, hi)

    def rescue(self, lo, hi, better, free):
        movie, size = range(len(self.m)), hi - lo + 1
        mean = lambda seq: sum(x[2] for x in seq) / len(seq)
        if free():
            votes = {}
            for si in range(lo, hi + 1, 2):
                for mi, s in self.leaders([(mi, self.best(si, mi)) for mi in movie])[:10]:
                    b = votes.setdefault(rnd((mi - si) / 8), [0, 0.0, -1.0, 0, 0])
                    b[0], b[1] = b[0] + 1, b[1] + s
                    if s > b[2]:
                        b[2:] = [s, si, mi]
            top = sorted(votes.values(), key=lambda b: (-b[0], -b[1]))[:20]
            best = None
            for b in top:
                seq = self.sequence(b[3], b[4], lo, hi)
                best = better(best, seq) if mean(seq) >= 32 else best
            if best:
                self.accept(best[0], True)
            if top:
                self.offer([(b[4] - b[3], b[1] / b[0]) for b in top], lo, hi)
        if free():
            mid, probes = rnd((lo + hi) / 2), list(range(lo, hi + 1, max(1, size // 12)))
            found = []
            for slope in (0.5, 0.6, 0.7, 0.8, 1.25, 1.5, 1.75, 2.0) if len(probes) > 1 else ():
                scored = []
                for anchor in range(0, len(self.m), 4):
                    at = [(si, rnd(anchor + slope * (si - mid))) for si in probes]
                    hit = [self.fast(si, mi) for si, mi in at if 0 <= mi < len(self.m)]
                    if len(hit) >= max(2, len(probes) // 2):
                        scored.append((anchor, sum(hit) / len(hit)))
                found += self.leaders(scored)[:4]
            found = sorted(((a, 0.5 * s + 0.5 * self.frame(mid, a)) for a, s in found), key=lambda x: -x[1])[:12]
            best = None
            for a, _ in found:
                seq = self.sequence(mid, a, lo, hi)
                best = better(best, seq) if mean(seq) >= 32 else best
            if best:
                self.accept(best[0], True)
            if found:
                self.offer([(a - mid, s) for a, s in found], lo, hi)

    def segment(self, seq, approximate):
        n, (si0, si1) = len(seq), (seq[0][0], seq[-1][0])
        xs, ys = [x[0] for x in seq], [x[1] for x in seq]
        mx, my = sum(xs) / n, sum(ys) / n
        var = sum((x - mx) ** 2 for x in xs)
        slope = min(8, max(0.1, sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / var if n > 1 and var else 1.0))
        line = seq[0][1] + rnd(slope * (si1 - si0))
        end = min(len(self.m) - 1, max(0, line)) if abs(line - seq[-1][1]) > 1 else seq[-1][1]
        top = max(range(n), key=lambda k: (seq[k][2], -k))
        return {
            "short_start": self.s[si0]["ts"], "short_end": self.s[si1]["ts"], "movie_start": self.m[seq[0][1]]["ts"], "movie_end": self.m[end]["ts"],
            "confidence": sum(x[2] for x in seq) / n, "frame_count": n, "gap_count": si1 - si0 + 1 - len(set(xs)), "speed_ratio": slope,
            "is_approximate": approximate, "best": seq[top][:2], "seq": seq,
        }

    def detail(self, si, mi):
        s, m = self.s[si], self.m[mi]
        best, crop = 0, "full"
        for u in s["variants"]:
            for v in m["variants"]:
                if pair(u, v) > best:
                    best, crop = pair(u, v), v["name"]
        shares = [min(100, max(0, x * 100)) for x in grids(s, m, False)] if s["color"] and m["color"] else [50.0] * 3
        return [crop, best, *shares]


def frame_time(video):
    steps = [b["ts"] - a["ts"] for a, b in zip(video[:201], video[1:201], strict=False)]
    steps = sorted(x for x in steps if x > 0)
    return steps[len(steps) // 2] if steps else 0.0


def whole(short, movie, profile, **limits):
    """Final segments and unmatched ranges (I1 to I6)."""
    run = Match(short, movie, profile, **limits)
    found, pool = run.run()
    made = sorted((run.segment(*x) for x in found), key=lambda x: x["short_start"])
    merged = []
    for x in made:
        x = x | {"detail": run.detail(*x["best"])}
        if merged:
            c = merged[-1]
            gap, jump = x["short_start"] - c["short_end"], x["movie_start"] - c["movie_end"]
            if -0.04 <= gap <= 0.52 and -0.08 <= jump <= gap * 5 + 2.5:
                f, g = c["frame_count"], x["frame_count"]
                merged[-1] = c | {
                    "short_end": x["short_end"], "movie_end": x["movie_end"], "frame_count": f + g, "seq": c["seq"] + x["seq"],
                    "confidence": (c["confidence"] * f + x["confidence"] * g) / (f + g), "speed_ratio": (c["speed_ratio"] * f + x["speed_ratio"] * g) / (f + g),
                    "gap_count": c["gap_count"] + x["gap_count"] + rnd(gap * 25), "is_approximate": c["is_approximate"] or x["is_approximate"],
                    "detail": c["detail"] if c["confidence"] >= x["confidence"] else x["detail"],
                }
                continue
        merged.append(x)
    kept = []
    for x in sorted(merged, key=lambda x: -x["confidence"]):
        if all(min(k["short_end"], x["short_end"]) - max(k["short_start"], x["short_start"]) <= 0.15 for k in kept):
            kept.append(x)
    kept.sort(key=lambda x: x["short_start"])
    final = []
    for i, x in enumerate(kept):
        good = lambda a, b, c: a["confidence"] >= 85 and -1 <= c["movie_start"] - b["movie_end"] <= 10
        sure = len(kept) <= 1 or not x["is_approximate"] or x["confidence"] >= 80 or x["frame_count"] >= 20
        if sure or final and good(final[-1], final[-1], x) or i + 1 < len(kept) and good(kept[i + 1], x, kept[i + 1]):
            final.append(x)
    used = {f"{short[a]['ts']:.4f}" for x in final for a, _, _ in x["seq"]}
    free, run_of = [], []
    for f in [*short, None]:
        if f is not None and f"{f['ts']:.4f}" not in used:
            run_of.append(f["ts"])
        elif run_of:
            free.append((run_of[0], run_of[-1], len(run_of)))
            run_of = []
    a, b = frame_time(short), frame_time(movie)
    late = lambda x: x | {"short_end": x["short_end"] + a, "movie_end": x["movie_end"] + b}
    return [late(x) for x in final], free, [late(run.segment(*x)) for x in pool], [late(x) for x in merged]
