"""Retrying segments: unchecked candidates first, then wider searches.

All candidate sets go through a click together.  A step is one plan over the sets
that are still open: the next candidates of each are judged, or a search is made
for all of them, and what comes back closes sets or not.  State is a row for each
set; candidates and verdicts are only ever added to.

Verdicts come from a function, so that the engine needs no model: it takes
candidates (rows with ``rank``) and returns them with ``same`` and
``confidence_pct``, and ``match_likelihood`` if it knows better.  A search is a
function too; ``broader_search`` makes the one that matches frames again.

A set (set_id, short_id, short_start, short_end, rounds, recovered_idx,
best_effort, dropped) remembers how many searches it has had, so that the next
click goes on where this one ended.  A candidate is (set_id, cand_idx,
short_start, short_end, movie_start, movie_end, confidence, checked, verdict,
confidence_pct, match_likelihood); none is judged twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ACCEPT_CONFIDENCE, match_likelihood, retry_params
from ..operators import intervals as iv
from ..operators import verification as ve
from ..shared import Tables
from .align import CANDIDATE
from .match import match

Judge = Callable[[DataFrame], DataFrame]
Search = Callable[[DataFrame], DataFrame]
#: Searches in a row without a new candidate after which a click ends.
EMPTY_ROUNDS = 2
#: New candidates of a search that are tried.
NEW_A_ROUND = 10
#: The first search from which on all have the same limits.
LAST_LIMITS = 6
_PLACE = ["short_start", "short_end", "movie_start", "movie_end", "confidence"]
_VERDICT = ["verdict", "confidence_pct", "match_likelihood"]


@dataclass
class Clicked:
    """What a click leaves: the sets and candidates as they are now, and a row
    (set_id, outcome, mode, accepted_idx, new_candidates, attempts,
    search_rounds) for each set.  They are tables of the shared folder;
    ``release`` removes them."""

    sets: DataFrame
    candidates: DataFrame
    outcomes: DataFrame
    release: Callable[[], None]


@dataclass
class Retry:
    """Outcome of a retry of one range: what was accepted or, failing that, the
    best guess."""

    outcome: str
    attempts: int
    rounds: int
    candidate: dict | None
    checked: list[dict]


def params(attempt: int) -> dict[str, float]:
    """Limits of the r-th wider search."""
    return {"min_similarity": max(20, 40 - 5 * attempt), "min_frames": max(2, 3 - (attempt > 0)), "frame_drift": min(24, 8 + 4 * attempt), "pad_seconds": min(6.0, 1.5 + 0.75 * attempt)}


def broader_search(short: DataFrame, movie: DataFrame) -> Search:
    """A search for sets (set_id, short_id, short_start, short_end, rounds): the
    frames of each range, with a margin, are a short of their own and are matched
    again with wider limits.  Gives (set_id, ord, place...): final segments, then
    the pool, without those near an earlier one, the most confident first."""

    def search(asked: DataFrame) -> DataFrame:
        limits = F.least(F.coalesce("rounds", F.lit(0)), F.lit(LAST_LIMITS))
        out: DataFrame | None = None
        for number in sorted(r["n"] for r in asked.select(limits.alias("n")).distinct().collect()):  # LAST_LIMITS + 1 at most
            p = params(number)
            mine = asked.filter(limits == number)
            ranges = mine.select(F.col("set_id"), F.col("short_id").cast("string").alias("match_id"), F.greatest(F.lit(0.0), F.col("short_start") - p["pad_seconds"]).alias("r_start"), (F.col("short_end") + p["pad_seconds"]).alias("r_end"))
            frames = short.withColumns({"match_id": F.col("video_id").cast("string"), "short_start": F.col("ts"), "short_end": F.col("ts")})
            part = iv.joined_by_time(ranges, frames).filter(F.col("ts").between(F.col("r_start"), F.col("r_end")))
            part = part.withColumn("video_id", F.col("set_id").cast("string")).select(*short.columns)
            got = match(part, movie, CANDIDATE, p["min_similarity"], int(p["min_frames"]), int(p["frame_drift"]))
            rank = lambda df, n: df.select("match_id", "seg_id", *_PLACE, F.lit(n).alias("_n"), (F.col("kind") == "alternate" if "kind" in df.columns else F.lit(False)).alias("_late"))
            found = rank(got.segments, 0).unionByName(rank(got.pool, 1))
            here = mine.select("set_id", F.col("set_id").cast("string").alias("match_id"), F.col("short_start").alias("_a"), F.col("short_end").alias("_b"))
            found = found.join(here, "match_id").filter(iv.overlap(F.col("short_start"), F.col("short_end"), F.col("_a"), F.col("_b")) > iv.OVERLAP)
            order = [F.col("_n"), F.col("_late"), F.when(F.col("_late"), 0.0).otherwise(F.col("short_start")), F.col("seg_id")]
            kept = iv.near_dedup(found, ["set_id"], order, _PLACE)
            w = Window.partitionBy("set_id").orderBy(F.desc("confidence"), "kept_idx")
            some = Tables(short.sparkSession).write(kept.select("set_id", F.row_number().over(w).alias("ord"), *_PLACE))
            got.release()
            out = some if out is None else out.unionByName(some)
        if out is None:
            raise ValueError("no set to search for")
        return out

    return search


def _judged(batch: DataFrame, judge: Judge) -> DataFrame:
    """Verdicts of candidates up to the first of each set that is accepted."""
    said = judge(batch)
    known = F.col("same").isNotNull()
    likely = match_likelihood(F.col("same"), F.col("confidence_pct"))
    if "match_likelihood" in said.columns:
        likely = F.coalesce("match_likelihood", likely)
    yes = F.coalesce(F.col("same") & (F.col("confidence_pct") >= ACCEPT_CONFIDENCE), F.lit(False))
    first = F.min(F.when(yes, F.col("rank"))).over(Window.partitionBy("set_id"))
    rows = said.withColumns({"_yes": yes, "_first": first}).filter(F.col("_first").isNull() | (F.col("rank") <= F.col("_first")))
    verdict = F.when(~known, "unverifiable").when(F.col("_yes"), "accepted").otherwise("rejected")
    return rows.select("set_id", "cand_idx", verdict.alias("verdict"), F.when(known, F.col("confidence_pct")).cast("double").alias("confidence_pct"), F.when(known, likely).cast("double").alias("match_likelihood"))


def click(sets: DataFrame, candidates: DataFrame, search: Search, judge: Judge, budget: int = ve.MAX_ATTEMPTS, ranker: Callable[[DataFrame], Column] | None = None,
          most_rounds: int | None = None, at_once: int = 1) -> Clicked:
    """One retry of every set: unchecked candidates, then wider searches, until
    one is accepted, ``budget`` candidates have been judged, or ``EMPTY_ROUNDS``
    searches in a row found nothing new.

    Each candidate that is judged uses up an attempt, also one without a verdict.
    Without an accept the most likely of all candidates that were ever judged
    stands in (``best_effort``); without any verdict the set is ``exhausted``.
    ``ranker`` gives the order of candidates that are tried together, as a column
    over them (larger first; ties and null keep the stored order).  ``at_once``
    candidates of a set are judged in one plan: 1 judges none in vain; where
    verdicts are a table, ``budget`` saves plans.
    """
    spark = sets.sparkSession
    tables, kept = Tables(spark), Tables(spark)
    try:
        sets, candidates = tables.write(sets), tables.write(candidates)
        fields = ["set_id", "cand_idx", *_PLACE]
        n = candidates.groupBy("set_id").agg(F.max("cand_idx").alias("_m"), F.count_if(~F.col("checked")).alias("_u"))
        state = sets.select("set_id").join(n, "set_id", "left").select(
            "set_id", (F.coalesce("_m", F.lit(-1)) + 1).cast("int").alias("n"), F.lit(0).alias("attempts"), F.lit(0).alias("empty"), F.lit(0).alias("searched"), F.lit(0).alias("added"),
            F.lit(None).cast("int").alias("accepted"), F.when(F.col("_u") > 0, "unchecked_pool").otherwise("broader_search").alias("mode"),
        )
        state = tables.write(state)
        new: list[DataFrame] = []
        verdicts: list[DataFrame] = []

        def tried(state: DataFrame, batch: DataFrame) -> DataFrame:
            """The state after candidates of each set are judged in turn."""
            score = ranker(batch) if ranker else F.lit(None).cast("double")
            w = Window.partitionBy("set_id").orderBy(F.desc_nulls_last("_score"), "cand_idx")
            batch = tables.write(batch.withColumn("_score", score).withColumn("rank", F.row_number().over(w)).drop("_score"))
            at, last = 0, batch.agg(F.max("rank")).first()[0] or 0
            while at < last:
                left = state.filter(F.col("accepted").isNull() & (F.col("attempts") < budget)).select("set_id", (budget - F.col("attempts")).alias("_left"))
                rows = batch.filter((F.col("rank") > at) & (F.col("rank") <= at + at_once)).join(left, "set_id").filter(F.col("rank") - at <= F.col("_left")).drop("_left")
                said = tables.write(_judged(rows, judge))
                got = said.groupBy("set_id").agg(F.count("*").alias("_n"), F.min(F.when(F.col("verdict") == "accepted", F.col("cand_idx"))).alias("_a"))
                if said.isEmpty():  # no set is open any more
                    break
                verdicts.append(said)
                state = tables.write(state.join(got, "set_id", "left").withColumns({"attempts": F.col("attempts") + F.coalesce("_n", F.lit(0)).cast("int"), "accepted": F.coalesce("accepted", F.col("_a")).cast("int")}).drop("_n", "_a"))
                at += at_once
            return state

        state = tried(state, candidates.filter(~F.col("checked")).select(*fields))
        while True:
            going = F.col("accepted").isNull() & (F.col("attempts") < budget) & (F.col("empty") < EMPTY_ROUNDS)
            if most_rounds is not None:
                going &= F.col("searched") < most_rounds
            todo = state.filter(going).select("set_id", "n", "searched")
            if todo.isEmpty():
                break
            asked = sets.join(todo, "set_id").withColumn("rounds", F.coalesce("rounds", F.lit(0)) + F.col("searched"))
            have = candidates.select("set_id", "movie_start")
            for some in new:
                have = have.unionByName(some.select("set_id", "movie_start"))
            found = search(asked.drop("n", "searched")).select("set_id", "ord", *_PLACE)
            found = ve.fresh(found, have.join(todo.select("set_id"), "set_id", "left_semi"), most=NEW_A_ROUND).join(todo, "set_id")
            fresh = tables.write(found.select("set_id", (F.col("n") + F.col("rank") - 1).cast("int").alias("cand_idx"), *_PLACE))
            new.append(fresh)
            got = todo.select("set_id").join(fresh.groupBy("set_id").agg(F.count("*").alias("_n")), "set_id", "left").select("set_id", F.coalesce("_n", F.lit(0)).cast("int").alias("_n"))
            step = F.col("_n").isNotNull()
            state = tables.write(state.join(got, "set_id", "left").withColumns({
                "n": F.col("n") + F.coalesce("_n", F.lit(0)), "added": F.col("added") + F.coalesce("_n", F.lit(0)), "searched": F.col("searched") + step.cast("int"),
                "empty": F.when(step & (F.col("_n") == 0), F.col("empty") + 1).when(step, 0).otherwise(F.col("empty")),
            }).drop("_n"))
            state = tried(state, fresh)

        # All candidates with what was said of them.
        everything = candidates.select(*fields, "checked", *_VERDICT)
        for some in new:
            none = {"checked": F.lit(False), "verdict": F.lit(None).cast("string"), "confidence_pct": F.lit(None).cast("double"), "match_likelihood": F.lit(None).cast("double")}
            everything = everything.unionByName(some.withColumns(none).select(*fields, "checked", *_VERDICT))
        if verdicts:
            said = verdicts[0]
            for some in verdicts[1:]:
                said = said.unionByName(some)
            said = said.select("set_id", "cand_idx", F.lit(True).alias("_said"), *[F.col(c).alias(f"_{c}") for c in _VERDICT])
            joined = everything.join(said, ["set_id", "cand_idx"], "left")
            now = F.col("_said").isNotNull()
            everything = joined.select(*fields, (F.col("checked") | now).alias("checked"), *[F.when(now, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in _VERDICT])
        everything = kept.write(everything)
        guess = ve.best_effort(everything).select("set_id", F.col("cand_idx").alias("_guess"))
        ended = kept.write(state.join(guess, "set_id", "left"))
        outcome = F.when(F.col("accepted").isNotNull(), "accepted").when(F.col("_guess").isNotNull(), "best_effort").otherwise("exhausted")
        ended = ended.withColumns({"outcome": outcome, "accepted_idx": F.coalesce("accepted", "_guess").cast("int")})
        outcomes = ended.select("set_id", "outcome", "mode", "accepted_idx", F.col("added").alias("new_candidates"), "attempts", F.col("searched").alias("search_rounds"))
        used = ended.select("set_id", "outcome", "accepted_idx", "searched")
        settled = F.col("outcome") != "exhausted"
        changed = sets.join(used, "set_id").withColumns({
            "rounds": (F.coalesce("rounds", F.lit(0)) + F.col("searched")).cast("int"), "recovered_idx": F.when(settled, F.col("accepted_idx")).otherwise(F.col("recovered_idx")).cast("int"),
            "best_effort": F.when(settled, F.col("outcome") == "best_effort").otherwise(F.col("best_effort")), "dropped": F.when(settled, False).otherwise(F.col("dropped")),
        })
        return Clicked(kept.write(changed.select(*sets.columns)), everything, outcomes, kept.drop)
    finally:
        tables.drop()


def retry(short: DataFrame, movie: DataFrame, pool: DataFrame, start: float, end: float, judge: Judge, budget: int = ve.MAX_ATTEMPTS, most_rounds: int | None = None, rounds: int = 0) -> Retry:
    """``click`` for one range of one short.  ``pool``: its candidates, the most
    confident first; ``rounds``: the searches that it has had."""
    spark = short.sparkSession
    first = short.select(F.col("video_id").cast("string").alias("v")).orderBy("v").first()
    one = spark.createDataFrame([(0, first["v"] if first else "", float(start), float(end), rounds, None, None, True)], SET)
    known = {"checked": F.lit(False), "verdict": F.lit(None).cast("string"), "confidence_pct": F.lit(None).cast("double"), "match_likelihood": F.lit(None).cast("double")}
    have = {c: F.col(c) if c in pool.columns else v for c, v in known.items()}
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("confidence"), "seg_id")  # the candidates of one range
    candidates = pool.select(F.lit(0).cast("long").alias("set_id"), (F.row_number().over(order) - 1).alias("cand_idx"), *_PLACE, *[v.alias(c) for c, v in have.items()])
    done = click(one, candidates, broader_search(short, movie), judge, budget, most_rounds=most_rounds)
    result = done.outcomes.first()
    checked = [r.asDict() for r in done.candidates.filter("checked").orderBy("cand_idx").limit(10_000).collect()]
    chosen = next((c for c in checked if c["cand_idx"] == result["accepted_idx"]), None)
    done.release()
    return Retry(result["outcome"], result["attempts"], result["search_rounds"], chosen, checked)


SET = "set_id long, short_id string, short_start double, short_end double, rounds int, recovered_idx int, best_effort boolean, dropped boolean"

__all__ = ["Clicked", "Retry", "broader_search", "click", "params", "retry", "retry_params"]
