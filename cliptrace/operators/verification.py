"""Verification state: candidate sets, verdicts, retries, tallies, quota.

Verdicts are a table; the model that gives them is outside the engine.  A
candidate is a row (set_id, cand_idx, ..., verdict, confidence_pct, ...) of a
candidate set (set_id, match_id, segment_idx, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ACCEPT_CONFIDENCE, fallback_score
from .intervals import away_from

#: Attempts of one verification loop.
MAX_ATTEMPTS = 10
#: Untried extras that a history keeps.
HISTORY_EXTRAS = 10
#: Requests of one model within a minute, and within a day.
RPM, RPD = 15, 500


def verify(ranked: DataFrame, key: list[str], attempts: int | None = MAX_ATTEMPTS) -> DataFrame:
    """(key..., attempts, accepted_rank, outcome) of trying candidates by rank
    until one is accepted: same, with enough confidence.

    ``ranked`` has ``rank``, ``same``, ``confidence_pct``.  Every candidate that
    is tried uses up one attempt, also one whose verdict failed for good (a null
    ``same``); only repeats of a failed request are free, and those are no rows.
    ``attempts`` of None tries all.  ``outcome`` is ``inconclusive`` where no
    tried candidate got a verdict.
    """
    w = Window.partitionBy(*key).orderBy("rank")
    tried = ranked.withColumn("_try", F.row_number().over(w))
    if attempts is not None:
        tried = tried.filter(F.col("_try") <= attempts)
    yes = F.col("same") & (F.col("confidence_pct") >= ACCEPT_CONFIDENCE)
    got = tried.groupBy(*key).agg(F.min(F.when(yes, F.col("rank"))).alias("accepted_rank"), F.max("_try").alias("_all"), F.min(F.when(yes, F.col("_try"))).alias("_till"), F.count("same").alias("_said"))
    outcome = F.when(F.col("accepted_rank").isNotNull(), "accepted").when(F.col("_said") == 0, "inconclusive").otherwise("rejected")
    return got.select(*key, F.coalesce("_till", "_all").cast("long").alias("attempts"), "accepted_rank", outcome.alias("outcome"))


def candidate_history(tried: DataFrame, extras: DataFrame, sets: DataFrame, most: int = HISTORY_EXTRAS) -> DataFrame:
    """All candidates of each set in stored order: tried ones by ``ord``, then
    up to ``most`` untried ones; with the index of the accepted one (the last
    tried, unless the set was dropped).  Sets without candidates have no rows."""
    w = Window.partitionBy("set_id").orderBy("ord")
    extra = extras.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    both = tried.withColumn("checked", F.lit(True)).unionByName(extra.withColumn("checked", F.lit(False)))
    order = Window.partitionBy("set_id").orderBy(F.desc("checked"), "ord")
    listed = both.withColumn("cand_idx", F.row_number().over(order) - 1)
    n_tried = F.sum(F.col("checked").cast("int")).over(Window.partitionBy("set_id"))
    return listed.withColumn("_tried", n_tried).join(sets.select("set_id", "dropped"), "set_id").withColumn(
        "accepted_idx", F.when(~F.col("dropped") & (F.col("_tried") > 0), F.col("_tried") - 1)
    ).drop("_tried")


def deferred_worklist(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates of sets that were not kept, unchecked or unverifiable."""
    open_sets = sets.filter(F.coalesce("dropped", F.lit(True))).select("set_id")
    return candidates.filter(~F.col("checked") | (F.col("verdict") == "unverifiable")).join(open_sets, "set_id", "left_semi")


def best_effort(candidates: DataFrame) -> DataFrame:
    """(set_id, cand_idx, score): the most likely candidate of each set; the
    first wins a tie."""
    score = fallback_score(F.col("match_likelihood"), F.col("verdict"), F.col("confidence_pct"))
    return candidates.withColumn("_s", score).filter("_s IS NOT NULL").groupBy("set_id").agg(F.max_by("cand_idx", F.struct("_s", -F.col("cand_idx"))).alias("cand_idx"), F.max("_s").alias("score"))


def fresh(found: DataFrame, existing: DataFrame, within: float = 0.5, most: int = 10) -> DataFrame:
    """Newly found candidates that start nowhere near an existing one of their
    set, the first ``most`` by ``ord``."""
    new = away_from(found, existing, ["set_id"], within=within)
    return new.withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy("ord"))).filter(F.col("rank") <= most)


def outcome_tallies(outcomes: DataFrame, key: list[str]) -> DataFrame:
    """Counts of outcomes per key."""
    n = lambda cond: F.count_if(cond)
    o = F.col("outcome")
    return outcomes.groupBy(*key).agg(
        n(o == "accepted").alias("accepted"), n(o == "rejected").alias("rejected"),
        n((o == "unverifiable") & (F.col("reason") == "network")).alias("inconclusive_network"),
        n((o == "unverifiable") & F.coalesce(F.col("reason") != "network", F.lit(True))).alias("other_unverifiable"),
        n(F.col("recovered")).alias("recovered_by_deferred"),
        n((o != "accepted") & ~F.col("recovered")).alias("still_unmatched"),
    )


def request_window(requests: DataFrame, key: str = "model", at: str = "ts", seconds: int = 60, limit: int = RPM) -> DataFrame:
    """Add ``in_window``: requests of the same key less than ``seconds`` ago,
    this one included, and ``over_limit``.

    Requests are dealt out by key and time slot, each to its own slot and the
    next, so that one busy key is spread over all tasks.
    """
    width = seconds * 1_000_000
    micros = F.unix_micros(at)
    slot = F.floor(micros / F.lit(width)).cast("long")
    dealt = requests.select("*", slot.alias("_own"), F.explode(F.array(slot, slot + 1)).alias("_slot"))
    w = Window.partitionBy(key, "_slot").orderBy(micros).rangeBetween(1 - width, 0)
    counted = dealt.withColumn("in_window", F.count("*").over(w)).filter("_own = _slot").drop("_own", "_slot")
    return counted.withColumn("over_limit", F.col("in_window") > limit)


def daily_usage(requests: DataFrame, key: str = "model", at: str = "ts", zone: str = "America/Los_Angeles", limit: int = RPD) -> DataFrame:
    """(key, day, used, remaining, exhausted): requests per day of ``zone``."""
    day = F.to_date(F.from_utc_timestamp(at, zone)).alias("day")
    got = requests.groupBy(key, day).agg(F.count("*").alias("used"))
    return got.withColumns({"remaining": F.greatest(F.lit(0).cast("long"), limit - F.col("used")), "exhausted": F.col("used") >= limit})


def quota_status(requests: DataFrame, now: str, key: str = "model", at: str = "ts", rpm: int = RPM, rpd: int = RPD) -> DataFrame:
    """What each model may still send at ``now`` (UTC): this minute and today."""
    t = F.lit(now).cast("timestamp")
    age = F.unix_micros(t) - F.unix_micros(at)
    today = F.to_date(F.from_utc_timestamp(at, "America/Los_Angeles")) == F.to_date(F.from_utc_timestamp(t, "America/Los_Angeles"))
    got = requests.groupBy(key).agg(F.count_if((age >= 0) & (age < 60_000_000)).alias("minute_used"), F.count_if(today & (age >= 0)).alias("day_used"))
    left = lambda c, n: F.greatest(F.lit(0).cast("long"), n - F.col(c))
    return got.withColumns({"minute_left": left("minute_used", rpm), "day_left": left("day_used", rpd)})


def deferred_pass(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The verification loop over what was put off, per set in stored order:
    until one is accepted, however many there are."""
    w = Window.partitionBy("set_id").orderBy("ord")
    return verify(deferred_worklist(candidates, sets).withColumn("rank", F.row_number().over(w)), ["set_id"], None)
