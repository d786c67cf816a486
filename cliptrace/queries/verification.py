"""Queries over verdicts, candidate sets, requests and scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import verification as ve
from ..plans import retry as rt
from ..streaming import pacing
from ..streaming.ingest import windowed_counts
from . import query
from .base import SEGMENTS_SQL, events, segments, table

#: Candidates of sets: segments of a match and kind, with made-up verdicts.
_CANDIDATES = """c AS (SELECT match_id * 6 + kind AS set_id, match_id, seg_id AS ord, movie_start, seg_id % 3 > 0 AS checked,
  CASE WHEN seg_id % 10 = 0 THEN NULL ELSE seg_id % 4 = 0 END AS same, confidence AS confidence_pct,
  CASE WHEN seg_id % 7 = 3 THEN NULL ELSE CASE seg_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'unverifiable' ELSE 'rejected' END END AS verdict, CASE WHEN seg_id % 4 = 1 THEN confidence / 2 END AS match_likelihood FROM s)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seg_id")
    return segments(spark, sf_dir).select(
        (F.col("match_id") * 6 + F.col("kind")).alias("set_id"), "match_id", n.alias("ord"), "movie_start", (n % 3 > 0).alias("checked"),
        F.when(n % 10 != 0, n % 4 == 0).alias("same"), F.col("confidence").alias("confidence_pct"),
        F.when(n % 7 == 3, None).when(n % 5 == 0, "accepted").when(n % 5 == 1, "unverifiable").otherwise("rejected").alias("verdict"),
        F.when(n % 4 == 1, F.col("confidence") / 2).alias("match_likelihood"),
    )


@query("verify_loop", f"""
WITH {SEGMENTS_SQL}, {_CANDIDATES}, t AS (SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY ord) AS rank, same, confidence_pct FROM c),
k AS (SELECT * FROM t WHERE rank <= 10), a AS (SELECT set_id, min(rank) AS accepted_rank FROM k WHERE same AND confidence_pct >= 80 GROUP BY set_id),
g AS (SELECT set_id, count(*) AS tried, count(same) AS said FROM k GROUP BY set_id)
SELECT set_id, CAST(coalesce(accepted_rank, tried) AS BIGINT) AS attempts, CAST(accepted_rank AS INT) AS accepted_rank, CASE WHEN accepted_rank IS NOT NULL THEN 'accepted' WHEN said = 0 THEN 'inconclusive' ELSE 'rejected' END AS outcome FROM g LEFT JOIN a USING (set_id)""")
def verify_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ranked = _candidates(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy("ord")))
    return ve.verify(ranked, ["set_id"])


@query("candidate_history", f"""
WITH {SEGMENTS_SQL}, {_CANDIDATES}, e AS (SELECT * FROM c WHERE NOT checked QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY ord) <= 10), b AS (SELECT * FROM c WHERE checked UNION ALL SELECT * FROM e),
d AS (SELECT set_id, max(ord) % 4 = 0 AS dropped FROM c GROUP BY set_id)
SELECT set_id, ord, checked, CAST(row_number() OVER (PARTITION BY set_id ORDER BY checked DESC, ord) - 1 AS INT) AS cand_idx,
  CAST(CASE WHEN NOT dropped AND sum(CAST(checked AS INT)) OVER (PARTITION BY set_id) > 0 THEN sum(CAST(checked AS INT)) OVER (PARTITION BY set_id) - 1 END AS BIGINT) AS accepted_idx FROM b JOIN d USING (set_id)""")
def candidate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    sets = c.groupBy("set_id").agg((F.max("ord") % 4 == 0).alias("dropped"))
    got = ve.candidate_history(c.filter("checked").drop("checked"), c.filter("NOT checked").drop("checked"), sets)
    return got.select("set_id", "ord", "checked", "cand_idx", "accepted_idx")


@query("deferred_worklist", f"""
WITH {SEGMENTS_SQL}, {_CANDIDATES}, d AS (SELECT set_id, CASE WHEN max(ord) % 4 = 0 THEN NULL ELSE max(ord) % 4 = 1 END AS dropped FROM c GROUP BY set_id)
SELECT set_id, ord, verdict FROM c WHERE (NOT checked OR verdict = 'unverifiable') AND set_id IN (SELECT set_id FROM d WHERE coalesce(dropped, true))""")
def deferred_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    sets = c.groupBy("set_id").agg(F.when(F.max("ord") % 4 != 0, F.max("ord") % 4 == 1).alias("dropped"))
    return ve.deferred_worklist(c, sets).select("set_id", "ord", "verdict")


_SCORE = "coalesce(match_likelihood, CASE WHEN verdict IS NULL THEN NULL WHEN verdict = 'accepted' THEN confidence_pct ELSE 100 - confidence_pct END)"


@query("best_effort_pick", f"WITH {SEGMENTS_SQL}, {_CANDIDATES}, x AS (SELECT set_id, ord, {_SCORE} AS sc FROM c WHERE {_SCORE} IS NOT NULL) SELECT set_id, ord AS cand_idx, round(sc, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY sc DESC, ord) = 1")
def best_effort_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ve.best_effort(_candidates(spark, sf_dir).withColumnRenamed("ord", "cand_idx")).withColumn("score", F.round("score", 6))


@query("fresh_candidates", f"""
WITH {SEGMENTS_SQL}, {_CANDIDATES}, n AS (SELECT * FROM c WHERE NOT checked AND NOT EXISTS (SELECT 1 FROM c h WHERE h.checked AND h.set_id = c.set_id AND abs(h.movie_start - c.movie_start) <= 0.5e0))
SELECT set_id, ord, CAST(row_number() OVER (PARTITION BY set_id ORDER BY ord) AS INT) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY ord) <= 10""")
def fresh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return ve.fresh(c.filter("NOT checked"), c.filter("checked")).select("set_id", "ord", "rank")


@query("outcome_tallies", f"""
WITH {SEGMENTS_SQL}, {_CANDIDATES}, o AS (SELECT match_id, verdict AS outcome, CASE WHEN ord % 2 = 0 THEN 'network' WHEN ord % 7 = 1 THEN NULL ELSE 'other' END AS reason, ord % 9 = 0 AS recovered FROM c)
SELECT match_id, count_if(outcome = 'accepted') AS accepted, count_if(outcome = 'rejected') AS rejected, count_if(outcome = 'unverifiable' AND reason = 'network') AS inconclusive_network,
  count_if(outcome = 'unverifiable' AND coalesce(reason <> 'network', true)) AS other_unverifiable, count_if(recovered) AS recovered_by_deferred, count_if(outcome <> 'accepted' AND NOT recovered) AS still_unmatched FROM o GROUP BY match_id""")
def outcome_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ord")
    o = _candidates(spark, sf_dir).select("match_id", F.col("verdict").alias("outcome"), F.when(n % 2 == 0, "network").when(n % 7 == 1, None).otherwise("other").alias("reason"), (n % 9 == 0).alias("recovered"))
    return ve.outcome_tallies(o, ["match_id"])


@query("quota_window_60s", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) > 15 AS over_limit FROM events")
def quota_window_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ve.request_window(events(spark, sf_dir), "event_type").select("event_id", "in_window", "over_limit")


# Pacific standard time holds over all of the table's January.
@query("pacific_day_usage", "WITH g AS (SELECT event_type, CAST(ts - INTERVAL 8 HOUR AS DATE) AS day, count(*) AS used FROM events GROUP BY ALL) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, used, greatest(0, 500 - used) AS remaining, used >= 500 AS exhausted FROM g")
def pacific_day_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ve.daily_usage(events(spark, sf_dir), "event_type").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("quota_status", """
SELECT event_type, count_if(ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts > TIMESTAMP '2024-01-15 11:59:00') AS minute_used, count_if(ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts >= TIMESTAMP '2024-01-15 08:00:00') AS day_used,
  greatest(0, 15 - count_if(ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts > TIMESTAMP '2024-01-15 11:59:00')) AS minute_left, greatest(0, 500 - count_if(ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts >= TIMESTAMP '2024-01-15 08:00:00')) AS day_left FROM events GROUP BY event_type""")
def quota_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ve.quota_status(events(spark, sf_dir), "2024-01-15 12:00:00+00:00", "event_type")


@query("windowed_counts", "SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windowed_counts(events(spark, sf_dir))
    start = F.date_format(F.to_utc_timestamp("window_start", F.current_timezone()), "yyyy-MM-dd HH:mm")
    return got.select(start.alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("match_likelihood", f"WITH {SEGMENTS_SQL}, {_CANDIDATES} SELECT set_id, ord, round(CASE WHEN same THEN confidence_pct ELSE 100 - confidence_pct END, 6) AS likelihood, round({_SCORE}, 6) AS score FROM c")
def match_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = tx.match_likelihood(F.col("same"), F.col("confidence_pct"))
    score = tx.fallback_score(F.col("match_likelihood"), F.col("verdict"), F.col("confidence_pct"))
    return _candidates(spark, sf_dir).select("set_id", "ord", F.round(like, 6).alias("likelihood"), F.round(score, 6).alias("score"))


@query("fps_tiers", f"""
WITH {SEGMENTS_SQL}, d AS (SELECT seg_id, short_end - short_start AS a, (movie_end - movie_start) * 3 AS b FROM s)
SELECT seg_id, CASE WHEN a < 0.5e0 THEN 7 WHEN a <= 2 THEN 3 ELSE 1 END AS fps, CASE WHEN least(a, b) < 0.5e0 THEN 7 WHEN least(a, b) <= 2 THEN 3 ELSE 1 END AS pair_fps FROM d""")
def fps_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("short_end") - F.col("short_start"), (F.col("movie_end") - F.col("movie_start")) * 3
    return segments(spark, sf_dir).select("seg_id", tx.sample_fps(a).alias("fps"), tx.sample_fps(F.least(a, b)).alias("pair_fps"))


@query("retry_params", "SELECT p_partkey, greatest(20, 40 - 5 * (p_size % 7)) AS min_similarity, greatest(2, CASE WHEN p_size % 7 > 0 THEN 2 ELSE 3 END) AS min_frames, least(24, 8 + 4 * (p_size % 7)) AS frame_drift, least(6e0, 1.5e0 + 0.75e0 * (p_size % 7)) AS pad_seconds FROM part")
def retry_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tx.retry_params(F.col("p_size") % 7)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in got.items()])


@query("cut_window", f"""
WITH {SEGMENTS_SQL}, w AS (SELECT seg_id, short_start - 1e0 AS a, short_start - 1e0 + (short_end - short_start) * 80 - 20 AS b FROM s),
v AS (SELECT seg_id, greatest(a, 0) AS f, greatest(b - greatest(a, 0), 0.04e0) AS n FROM w)
SELECT seg_id, round(CASE WHEN n > 60 THEN f + (n - 60) / 2 ELSE f END, 6) AS cut_start, round(least(n, 60), 6) AS cut_seconds FROM v""")
def cut_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("short_start") - 1.0
    start, seconds = tx.cut_window(a, a + (F.col("short_end") - F.col("short_start")) * 80 - 20)
    return segments(spark, sf_dir).select("seg_id", F.round(start, 6).alias("cut_start"), F.round(seconds, 6).alias("cut_seconds"))


@query("backoff", "SELECT p_partkey, CASE least(p_size % 5, 2) WHEN 0 THEN 2000 WHEN 1 THEN 8000 ELSE 30000 END AS wait_ms FROM part")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.backoff_ms(F.col("p_size") % 5).alias("wait_ms"))


#: Answers of a server: quota messages of several kinds around an event's own text.
_MESSAGES = """CASE event_id % 5 WHEN 0 THEN 'GenerateRequestsPerDayPerProject' WHEN 1 THEN 'quota per Day exceeded' WHEN 2 THEN 'too many requests per minute' WHEN 3 THEN 'DAILY limit' ELSE NULL END"""


@query("daily_limit", f"SELECT event_id, coalesce(lower(m) LIKE '%perday%' OR lower(m) LIKE '%per day%' OR contains(lower(m), 'daily'), false) AS daily FROM (SELECT event_id, {_MESSAGES} || ' ' || props AS m FROM events)")
def daily_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.expr(_MESSAGES), F.lit(" "), F.col("props"))
    return events(spark, sf_dir).select("event_id", tx.is_daily_limit(message).alias("daily"))


@query("clock", f"WITH {SEGMENTS_SQL} SELECT seg_id, printf('%02d:%02d.%02d', CAST(floor(short_end) AS INT) // 60, CAST(floor(short_end) AS INT) % 60, CAST(floor((short_end - floor(short_end)) * 100) AS INT)) AS clock FROM s")
def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("seg_id", tx.clock(F.col("short_end")).alias("clock"))


@query("confidence_tiers", f"WITH {SEGMENTS_SQL} SELECT seg_id, CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END AS tier, is_approximate FROM s")
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("seg_id", tx.confidence_tier(F.col("confidence")).alias("tier"), "is_approximate")


@query("verdict_parse", """
SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 2 = 0 END AS same, CASE WHEN event_id % 5 > 0 THEN least(100e0, value) END AS confidence, CAST(CASE WHEN event_id % 5 > 0 THEN 1 END AS INT) AS lines FROM events""")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, said = F.col("event_id"), F.to_json(F.struct((F.col("event_id") % 2 == 0).alias("same"), F.col("value").alias("confidence"), F.array(F.col("event_type"), F.lit(" ")).alias("evidence")))
    answer = F.when(n % 5 == 0, F.concat(F.lit("no verdict: "), F.col("props"))).otherwise(F.concat(F.lit('first {"same": true, "confidence": 1} then ```json\n'), said, F.lit("\n``` done }")))
    got = events(spark, sf_dir).withColumn("v", tx.parse_verdict(answer))
    return got.select("event_id", "v.same", "v.confidence", F.when(F.col("v.same").isNotNull(), F.size("v.evidence")).alias("lines"))


@query("deferred_pass", f"""
WITH {SEGMENTS_SQL}, {_CANDIDATES}, d AS (SELECT set_id, max(ord) % 3 > 0 AS dropped FROM c GROUP BY set_id),
wl AS (SELECT * FROM c WHERE (NOT checked OR verdict = 'unverifiable') AND set_id IN (SELECT set_id FROM d WHERE dropped)),
t AS (SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY ord) AS rank, same, confidence_pct FROM wl)
SELECT set_id, CAST(coalesce(min(CASE WHEN same AND confidence_pct >= 80 THEN rank END), count(*)) AS BIGINT) AS attempts, CAST(min(CASE WHEN same AND confidence_pct >= 80 THEN rank END) AS INT) AS accepted_rank,
  CASE WHEN count_if(same AND confidence_pct >= 80) > 0 THEN 'accepted' WHEN count(same) = 0 THEN 'inconclusive' ELSE 'rejected' END AS outcome FROM t GROUP BY set_id""")
def deferred_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return ve.deferred_pass(c, c.groupBy("set_id").agg((F.max("ord") % 3 > 0).alias("dropped")))


# Retries of all sets: a fifth of a set's segments were checked, a fifth wait, and
# three fifths turn up in searches.  Verdicts are made up from where a place is.
_SAME = "CASE WHEN CAST(floor({m} * 10) AS BIGINT) % 10 = 0 THEN NULL ELSE CAST(floor({m} * 10) AS BIGINT) % 4 = 0 END"
_BUDGET = 4


def _turn(batch: str, left: str) -> str:
    """The part of a list of places that is judged: up to the first accept."""
    return f"list_slice({batch}, 1, least({left}, coalesce(list_position(list_transform({batch}, lambda x: x.yes), true), 999)))"


_RETRY_SQL = f"""
WITH RECURSIVE {SEGMENTS_SQL}, c AS (SELECT match_id * 6 + kind AS set_id, seg_id, seg_id % 5 AS part, CAST(floor(seg_id / 5) AS BIGINT) % 3 AS turn, movie_start AS m, confidence AS p, {_SAME.format(m="movie_start")} AS same FROM s),
j AS (SELECT *, coalesce(same AND p >= 80, false) AS yes, CASE WHEN same THEN p ELSE 100 - p END AS likely FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY seg_id) - 1 AS idx FROM j WHERE part < 2),
f AS (SELECT set_id, turn, list({{'m': m, 'yes': yes, 'same': same, 'likely': likely}} ORDER BY p DESC, seg_id) AS found FROM j WHERE part >= 2 GROUP BY ALL),
a AS (SELECT set_id, set_id % 2 AS rounds, count(k.idx) AS n, coalesce(list(k.m) FILTER (WHERE k.idx IS NOT NULL), []) AS known,
  coalesce(list({{'idx': idx, 'yes': k.yes, 'same': k.same, 'likely': k.likely}} ORDER BY idx) FILTER (WHERE k.part = 1), []) AS waiting,
  coalesce(list({{'idx': idx, 'score': 100 - k.p / 2}} ORDER BY idx) FILTER (WHERE k.part = 0), []) AS said FROM (SELECT DISTINCT set_id FROM c) LEFT JOIN k USING (set_id) GROUP BY set_id),
b AS (SELECT *, {_turn("waiting", str(_BUDGET))} AS tried FROM a),
r AS (
  SELECT set_id, rounds, n, known, len(tried) AS attempts, 0 AS empty, 0 AS searched, 0 AS added, list_extract(list_transform(list_filter(tried, lambda x: x.yes), lambda x: x.idx), 1) AS accepted,
    list_concat(said, list_transform(list_filter(tried, lambda x: x.same IS NOT NULL), lambda x: {{'idx': x.idx, 'score': x.likely}})) AS said, CASE WHEN len(waiting) > 0 THEN 'unchecked_pool' ELSE 'broader_search' END AS mode FROM b
  UNION ALL
  SELECT set_id, rounds, n + len(new), list_concat(known, list_transform(new, lambda x: x.m)), attempts + len(tried), CASE WHEN len(new) > 0 THEN 0 ELSE empty + 1 END, searched + 1, added + len(new),
    n - 1 + list_position(list_transform(tried, lambda x: x.yes), true),
    list_concat(said, list_filter(list_transform(tried, lambda x, i: {{'idx': n - 1 + i, 'score': CASE WHEN x.same IS NOT NULL THEN x.likely END}}), lambda y: y.score IS NOT NULL)), mode
  FROM (SELECT *, {_turn("new", f"{_BUDGET} - attempts")} AS tried FROM (
    SELECT r.*, coalesce(list_slice(list_filter(f.found, lambda x: len(list_filter(known, lambda z: abs(z - x.m) <= 0.5e0)) = 0), 1, 10), []) AS new
    FROM r LEFT JOIN f ON f.set_id = r.set_id AND f.turn = (r.rounds + r.searched) % 3 WHERE accepted IS NULL AND attempts < {_BUDGET} AND empty < 2))
), last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY searched DESC) = 1),
g AS (SELECT set_id, arg_max(idx, struct_pack(a := score, b := -idx)) AS guess FROM (SELECT set_id, unnest(said, recursive := true) FROM last) GROUP BY set_id)
SELECT set_id, CASE WHEN accepted IS NOT NULL THEN 'accepted' WHEN guess IS NOT NULL THEN 'best_effort' ELSE 'exhausted' END AS outcome, mode, CAST(coalesce(accepted, guess) AS INTEGER) AS accepted_idx,
  CAST(added AS INTEGER) AS new_candidates, CAST(attempts AS INTEGER) AS attempts, CAST(searched AS INTEGER) AS search_rounds, CAST(rounds + searched AS INTEGER) AS rounds FROM last LEFT JOIN g USING (set_id)"""


def made_up_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, rt.Search]:
    """Sets, their candidates, and a search that knows the other segments."""
    from pyspark.sql import Window

    n = F.col("seg_id")
    c = segments(spark, sf_dir).withColumns({"set_id": (F.col("match_id") * 6 + F.col("kind")).cast("long"), "part": n % 5, "turn": F.floor(n / 5) % 3})
    none = lambda kind: F.lit(None).cast(kind)
    sets = c.groupBy("set_id").agg(F.min("match_id").cast("string").alias("short_id"), F.min("short_start").alias("short_start"), F.max("short_end").alias("short_end"))
    sets = sets.withColumns({"rounds": (F.col("set_id") % 2).cast("int"), "recovered_idx": none("int"), "best_effort": none("boolean"), "dropped": F.lit(True)})
    place = ["short_start", "short_end", "movie_start", "movie_end", "confidence"]
    checked = F.col("part") == 0
    w = Window.partitionBy("set_id").orderBy("seg_id")
    have = c.filter("part < 2").select(
        "set_id", (F.row_number().over(w) - 1).alias("cand_idx"), *place, checked.alias("checked"), F.when(checked, "rejected").alias("verdict"),
        F.when(checked, F.col("confidence") / 2).alias("confidence_pct"), none("double").alias("match_likelihood"),
    )
    rank = F.row_number().over(Window.partitionBy("set_id", "turn").orderBy(F.desc("confidence"), "seg_id"))
    found = c.filter("part >= 2").select("set_id", "turn", rank.alias("ord"), *place)
    return sets, have, lambda asked: found.join(asked.select("set_id", (F.col("rounds") % 3).alias("turn")), ["set_id", "turn"], "left_semi")


def made_up_judge(batch: DataFrame) -> DataFrame:
    """Verdicts from where a place is."""
    return batch.withColumns({"same": F.expr(_SAME.format(m="movie_start")), "confidence_pct": F.col("confidence")})


@query("retry_rounds", _RETRY_SQL)
def retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, have, search = made_up_sets(spark, sf_dir)
    done = rt.click(sets, have, search, made_up_judge, _BUDGET, at_once=_BUDGET)
    return done.outcomes.join(done.sets.select("set_id", "rounds"), "set_id")


# Requests: events, five hundred times as fast, from half an hour before a Pacific midnight on.
_RPM, _RPD = 5, 200
_START = "TIMESTAMP '2024-01-15 07:30:00'"
_MODEL_FREE = "CASE WHEN {u} >= {rpd} THEN NULL WHEN len({w}) < {rpm} THEN m ELSE {w}[1] + 60250 END"
_PACE_SQL = f"""
WITH RECURSIVE q AS (SELECT event_type AS caller, event_id AS request_id, epoch_ms({_START}) + (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 500000 AS due FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY due, request_id) AS rn FROM q),
r AS (
  SELECT caller, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS model, CAST(0 AS BIGINT) AS g, CAST([] AS BIGINT[]) AS w1, CAST([] AS BIGINT[]) AS w2, CAST(0 AS BIGINT) AS u1, CAST(0 AS BIGINT) AS u2, CAST(-1 AS BIGINT) AS day FROM o GROUP BY caller
  UNION ALL
  SELECT caller, rn, request_id, CASE k WHEN 1 THEN 'primary' WHEN 2 THEN 'fallback' END, CASE WHEN k = 0 THEN m ELSE due END,
    CASE WHEN k = 1 THEN list_append(w1, due) ELSE w1 END, CASE WHEN k = 2 THEN list_append(w2, due) ELSE w2 END, u1 + CAST(k = 1 AS INT), u2 + CAST(k = 2 AS INT), day
  FROM (SELECT caller, rn, request_id, m, coalesce(due, m) AS due, CASE WHEN due IS NULL THEN 0 WHEN u1 < {_RPD} AND len(w1) < {_RPM} THEN 1 ELSE 2 END AS k, w1, w2, u1, u2, day FROM (
    -- at the time of sending: the day may have turned, windows have moved on
    SELECT caller, rn, request_id, m, due, CASE WHEN turned THEN 0 ELSE u1 END AS u1, CASE WHEN turned THEN 0 ELSE u2 END AS u2, coalesce(today, day) AS day,
      CASE WHEN turned THEN [] ELSE list_filter(w1, lambda t: coalesce(due, m) - t < 60000) END AS w1, CASE WHEN turned THEN [] ELSE list_filter(w2, lambda t: coalesce(due, m) - t < 60000) END AS w2
    FROM (SELECT *, (due - 28800000) // 86400000 AS today, coalesce((due - 28800000) // 86400000 <> day, false) AS turned FROM (
      SELECT *, least({_MODEL_FREE.format(u="u1", w="w1", rpm=_RPM, rpd=_RPD)}, {_MODEL_FREE.format(u="u2", w="w2", rpm=_RPM, rpd=_RPD)}) AS due FROM (
        SELECT caller, rn, request_id, m, CASE WHEN d <> day THEN 0 ELSE u1 END AS u1, CASE WHEN d <> day THEN 0 ELSE u2 END AS u2, d AS day,
          CASE WHEN d <> day THEN [] ELSE list_filter(w1, lambda t: m - t < 60000) END AS w1, CASE WHEN d <> day THEN [] ELSE list_filter(w2, lambda t: m - t < 60000) END AS w2
        FROM (SELECT o.caller, o.rn, o.request_id, greatest(o.due, r.g) AS m, (greatest(o.due, r.g) - 28800000) // 86400000 AS d, r.u1, r.u2, r.w1, r.w2, r.day FROM r JOIN o ON o.caller = r.caller AND o.rn = r.rn + 1)
      )))))
)
SELECT caller, request_id, model, g AS sent_at, CASE WHEN model IS NULL THEN 'unavailable' ELSE 'granted' END AS outcome FROM r WHERE rn > 0"""


@query("rotating_pacer", _PACE_SQL)
def rotating_pacer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests over two models, with waits, daily limits and a day's turn."""
    e = events(spark, sf_dir)
    first = e.agg(F.min(F.unix_micros("ts"))).first()[0] or 0
    start = 1_705_303_800_000  # 07:30 UTC
    at = F.lit(start) + F.expr(f"(unix_micros(ts) - {first}) div 500000")
    rows = e.select(F.col("event_type").alias("caller"), F.timestamp_millis(at).alias("ts"), F.lit("request").alias("kind"), F.col("event_id").alias("request_id"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("long").alias("retry_ms"))
    return pacing.pace_table(rows, _RPM, _RPD, probe_ms=1 << 50)
