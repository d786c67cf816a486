"""Retries of many sets at once against one set after another in plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cliptrace.operators import intervals as iv
from cliptrace.plans import match as plan
from cliptrace.plans import retry as rt
from cliptrace.plans.align import CANDIDATE

from .test_matching import clip  # noqa: F401  a fixture

CAND = "set_id long, cand_idx int, short_start double, short_end double, movie_start double, movie_end double, confidence double, checked boolean, verdict string, confidence_pct double, match_likelihood double"


def said(place):
    """The made-up verdict of a place: (same, confidence, likelihood or None)."""
    k = int(place * 7)
    return (None if k % 9 == 0 else k % 23 == 0, float(50 + k % 50), float(k % 97) if k % 5 == 0 else None)


def judge(batch):
    k = F.floor(F.col("movie_start") * 7).cast("long")
    return batch.withColumns({"same": F.when(k % 9 != 0, k % 23 == 0), "confidence_pct": (50 + k % 50).cast("double"), "match_likelihood": F.when(k % 5 == 0, (k % 97).cast("double"))})


def made(rng, n=14):
    """Sets, candidates and what searches would find, as dicts."""
    sets = [{"set_id": i, "rounds": rng.choice([0, 0, 1, 3]), "recovered_idx": None, "best_effort": None, "dropped": True} for i in range(n)]
    cands, finds = {}, {}
    for s in sets:
        i = s["set_id"]
        cands[i] = [{"m": round(rng.uniform(0, 300), 1), "checked": rng.random() < 0.4, "verdict": None, "conf": None, "like": None} for _ in range(rng.choice([0, 1, 3, 9]))]
        for c in cands[i]:
            if c["checked"]:
                c["verdict"] = rng.choice(["rejected", "unverifiable"])
                c["conf"] = float(rng.randrange(100)) if c["verdict"] == "rejected" else None
        finds[i] = {r: [round(rng.uniform(0, 60 if rng.random() < 0.3 else 300), 1) for _ in range(rng.choice([0, 0, 2, 15]))] for r in range(12)}
    return sets, cands, finds


def plain_click(s, cands, finds, budget, order=None):
    """One set, one candidate after the other."""
    attempts = searched = added = empty = 0
    accepted, waiting = None, [k for k, c in enumerate(cands) if not c["checked"]]
    mode = "unchecked_pool" if waiting else "broader_search"

    def batch(indexes):
        nonlocal attempts, accepted
        for k in sorted(indexes, key=lambda k: (-order(cands[k]["m"]) if order else 0, k)):
            if attempts >= budget:
                return
            attempts += 1
            same, conf, like = said(cands[k]["m"])
            cands[k] |= {"checked": True, "verdict": "unverifiable" if same is None else "accepted" if same and conf >= 80 else "rejected"}
            if same is not None:
                cands[k] |= {"conf": conf, "like": like if like is not None else conf if same else 100 - conf}
            else:
                cands[k] |= {"conf": None, "like": None}
            if cands[k]["verdict"] == "accepted":
                accepted = k
                return

    batch(waiting)
    while accepted is None and attempts < budget and empty < 2:
        fresh = [m for m in finds.get(s["rounds"], []) if all(abs(m - c["m"]) > 0.5 for c in cands)][:10]
        s["rounds"] += 1
        searched += 1
        empty = 0 if fresh else empty + 1
        first = len(cands)
        cands += [{"m": m, "checked": False, "verdict": None, "conf": None, "like": None} for m in fresh]
        added += len(fresh)
        batch(range(first, len(cands)))
    outcome, at = ("accepted", accepted) if accepted is not None else ("exhausted", None)
    if accepted is None:
        score = lambda c: c["like"] if c["like"] is not None else (c["conf"] if c["verdict"] == "accepted" else 100 - c["conf"]) if c["conf"] is not None and c["verdict"] else None
        scored = [(score(c), -k) for k, c in enumerate(cands) if score(c) is not None]
        if scored:
            outcome, at = "best_effort", -max(scored)[1]
    if at is not None:
        s |= {"recovered_idx": at, "best_effort": outcome == "best_effort", "dropped": False}
    return (s["set_id"], outcome, mode, at, added, attempts, searched)


@pytest.mark.parametrize(("at_once", "ranked"), [(1, False), (4, True)])
def test_two_clicks_in_a_row(spark, at_once, ranked):
    rng = random.Random(11)
    sets, cands, finds = made(rng)
    # A place is found once: a search lists no two within half a second.
    for per_round in finds.values():
        for r, places in per_round.items():
            kept = []
            for m in places:
                if all(abs(m - k) > 0.5 for k in kept):
                    kept.append(m)
            per_round[r] = kept
    df_sets = spark.createDataFrame([(s["set_id"], "v", 0.0, 1.0, s["rounds"], None, None, True) for s in sets], rt.SET)
    rows = [(i, k, 0.0, 1.0, c["m"], c["m"] + 1, 50.0, c["checked"], c["verdict"], c["conf"], c["like"]) for i, mine in cands.items() for k, c in enumerate(mine)]
    df_cands = spark.createDataFrame(rows, CAND)
    known = spark.createDataFrame([(i, r, n, 0.0, 1.0, m, m + 1, 50.0) for i, per in finds.items() for r, places in per.items() for n, m in enumerate(places)], "set_id long, rounds int, ord int, short_start double, short_end double, movie_start double, movie_end double, confidence double")
    search = lambda asked: known.join(asked.select("set_id", "rounds"), ["set_id", "rounds"], "left_semi")
    ranker = (lambda batch: F.col("movie_start") % 10) if ranked else None
    order = (lambda m: m % 10) if ranked else None
    asked = []
    noted = lambda batch: asked.append(batch.count()) or judge(batch)
    seen = set()
    for _ in range(2):
        done = rt.click(df_sets, df_cands, search, noted, 4, ranker=ranker, at_once=at_once)
        want = [plain_click(s, cands[s["set_id"]], finds[s["set_id"]], 4, order) for s in sets]
        assert sorted(tuple(r) for r in done.outcomes.collect()) == want
        seen |= {w[1] for w in want}
        got = {(r["set_id"], r["cand_idx"]): (r["movie_start"], r["checked"], r["verdict"], r["confidence_pct"], r["match_likelihood"]) for r in done.candidates.collect()}
        assert got == {(i, k): (c["m"], c["checked"], c["verdict"], c["conf"], c["like"]) for i, mine in cands.items() for k, c in enumerate(mine)}
        assert sorted((r["set_id"], r["rounds"], r["recovered_idx"], r["best_effort"], r["dropped"]) for r in done.sets.collect()) == [(s["set_id"], s["rounds"], s["recovered_idx"], s["best_effort"], s["dropped"]) for s in sets]
        df_sets, df_cands = (spark.createDataFrame(x.collect(), x.schema) for x in (done.sets, done.candidates))
        done.release()
    assert seen == {"accepted", "best_effort", "exhausted"}
    if at_once == 1:  # none is judged in vain
        assert sum(asked) == sum(c["checked"] for mine in cands.values() for c in mine) - sum(r[7] for r in rows)


def test_nothing_to_retry(spark):
    none = lambda asked: spark.createDataFrame([], "set_id long, ord int, short_start double, short_end double, movie_start double, movie_end double, confidence double")
    empty = rt.click(spark.createDataFrame([], rt.SET), spark.createDataFrame([], CAND), none, judge)
    assert empty.outcomes.count() == empty.candidates.count() == empty.sets.count() == 0
    one = rt.click(spark.createDataFrame([(1, "v", 0.0, 1.0, None, None, None, None)], rt.SET), spark.createDataFrame([], CAND), none, judge)
    assert [tuple(r) for r in one.outcomes.collect()] == [(1, "exhausted", "broader_search", None, 0, 0, 2)]
    assert one.sets.first()["rounds"] == 2


def test_a_second_click_widens_and_offers_no_place_again(spark, clip):  # noqa: F811
    short, movie = clip
    never = lambda c: c.withColumns({"same": F.lit(False), "confidence_pct": F.lit(60.0)})
    sets = spark.createDataFrame([(4, "short", 0.0, 3.2, 0, None, None, True), (5, "short", 1.0, 2.0, 0, None, None, True)], rt.SET)
    search = rt.broader_search(short, movie)
    first = rt.click(sets, spark.createDataFrame([], CAND), search, never, budget=3, at_once=3)
    again = rt.click(first.sets, first.candidates, search, never, budget=30, at_once=30)
    a, b = ({(r["set_id"], r["cand_idx"]): r["movie_start"] for r in x.candidates.collect()} for x in (first, again))
    assert set(a) <= set(b) and all(b[k] == a[k] for k in a)
    for i in (4, 5):
        mine = [m for (s, _), m in b.items() if s == i]
        assert mine and all(abs(x - y) > 0.5 for k, x in enumerate(mine) for y in mine[:k])
    assert all(y["rounds"] > x["rounds"] for x, y in zip(first.sets.orderBy("set_id").collect(), again.sets.orderBy("set_id").collect(), strict=True))
    # What a search gives: final segments first, then the pool, near places once.
    found = search(sets.filter("set_id = 4")).orderBy("ord").collect()
    whole = plan.match(short.withColumn("video_id", F.lit("4")), movie, CANDIDATE, 40, 3, 8)
    best = whole.segments.orderBy("short_start").first()
    assert any(abs(r["movie_start"] - best["movie_start"]) < 1e-9 and r["confidence"] == best["confidence"] for r in found)
    assert [r["confidence"] for r in found] == sorted((r["confidence"] for r in found), reverse=True)


def test_away_from_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), k, rng.choice([None, round(rng.uniform(-5, 40), 1)])) for k in range(300)]
    places = [(rng.randrange(3), rng.choice([None, round(rng.uniform(-5, 40), 1)])) for _ in range(40)]
    got = iv.away_from(spark.createDataFrame(rows, "set_id int, k int, movie_start double"), spark.createDataFrame(places, "set_id int, movie_start double"), ["set_id"])
    want = sorted(k for s, k, m in rows if m is None or not any(p is not None and s == t and abs(m - p) <= 0.5 for t, p in places))
    assert sorted(r["k"] for r in got.collect()) == want and got.columns == ["set_id", "k", "movie_start"]
