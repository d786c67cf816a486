"""URL filtering by listed rules and by mined association rules.

Spark's FP-growth mines combinations of URL tokens that go with the label
"unwanted".  They are pruned by support and confidence over all labelled urls,
and matched through an inverted index from a rule's rarest token to the rule.

A null url, or one without ``://``, has an empty host and path, fits no rule
and is allowed.  Urls of any length are judged whole; repeated rows are judged
alike, of rules of equal length the first listed one wins; an empty table stays
empty.  Columns with the names of the output are replaced, others are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drawn, fresh

#: Labelled urls that rules are mined from, about, whatever their number.
MAX_LABELLED = 50_000
#: Rules that are sent to all tasks, at most; more are an error.
MAX_RULES = 20_000
#: Frequent tokens, of those that do not always occur together, that one url may
#: have; more are an error.
MAX_TOGETHER = 24
#: The item that stands for the label.
_BAD = "=unwanted"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: words of the host as ``h:``, words of the path as ``p:``
    with runs of digits as ``#``."""
    words = lambda c, lead: F.transform(
        F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}#]+"), lambda w: w != ""), lambda w: F.concat(F.lit(lead), w)
    )
    return F.array_distinct(F.concat(words(host, "h:"), words(F.regexp_replace(path, r"\d+", "#"), "p:")))


@dataclass(frozen=True)
class Rule:
    """A mined combination: urls with all ``tokens`` are unwanted."""

    tokens: frozenset[str]
    support: int
    confidence: float


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: Iterable[Rule]):
        rules = list(rules)
        often: dict[str, int] = defaultdict(int)
        for r in rules:
            for t in r.tokens:
                often[t] += 1
        self.by: dict[str, list[tuple[int, frozenset[str]]]] = defaultdict(list)
        for i, r in enumerate(rules):
            self.by[min(r.tokens, key=lambda t: (often[t], t))].append((i, r.tokens))

    def match(self, tokens: Iterable[str]) -> list[int]:
        """The rules that fit, by number."""
        have = set(tokens)
        return sorted(i for t in have for i, need in self.by.get(t, ()) if need <= have)


def mine(labelled: DataFrame, min_support: float = 0.02, min_count: int = 2, min_confidence: float = 0.9, masked: Sequence[str] = ()) -> list[Rule]:
    """Rules from ``labelled`` (url string, label int; 1: unwanted).

    Rows with a null label are left out.  ``min_support`` is a share of the
    unwanted urls, ``min_count`` a number of them.  ``masked`` are tokens that
    say how the labels were made: no rule may have them.

    A token that is a rule by itself is no item any more, since every longer
    combination with it would add nothing.  FP-growth then mines combinations of
    the others together with the label, so that supports and confidences are
    counts over all labelled urls of the sample.  Tokens that occur in the very
    same urls are one item, and a rule with it needs all of them: FP-growth looks
    at all combinations of what rows share.  Nothing is left out; more than
    ``MAX_TOGETHER`` items in one url are an error.
    """
    tokens = F.array_except(tokens_of(host_of(F.col("url")), path_of(F.col("url"))), F.array(*map(F.lit, masked)).cast("array<string>"))
    rows = labelled.select(tokens.alias("items"), F.col("label").cast("int").alias("label"), F.xxhash64("url").alias("at"))
    known = rows.filter("label IS NOT NULL")
    rows = cut(known.filter(drawn(F.col("at"), MAX_LABELLED, known.count())))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("bad")).first()
    least = max(min_count, min_support * sizes["bad"])
    if not sizes["bad"]:
        return []
    single = rows.select("label", F.explode("items").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("bad")).filter(F.col("bad") >= least)
    single = single.withColumn("confidence", F.col("bad") / F.col("n"))
    sure = [Rule(frozenset([r["t"]]), r["bad"], r["confidence"]) for r in _bounded(single.filter(F.col("confidence") >= min_confidence).orderBy("t"))]
    left = single.filter(F.col("confidence") < min_confidence).select("t")
    kept = cut(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "label", F.explode("items").alias("t")).join(left, "t"))
    # The urls of a token, as a number and a sum of hashes.
    alike = kept.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("h"))
    joint = cut(alike.groupBy("n", "h").agg(F.sort_array(F.collect_list("t")).alias("all")))
    lead = joint.select(F.col("all")[0].alias("t"))
    items = cut(kept.join(lead, "t", "left_semi").groupBy("row", "label").agg(F.collect_list("t").alias("items")))
    most = items.agg(F.max(F.size("items"))).first()[0] or 0
    if most > MAX_TOGETHER:
        raise ValueError(f"{most} frequent tokens in one url: raise min_support")
    items = items.select(F.when(F.col("label") == 1, F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=least / sizes["n"], minConfidence=min_confidence).fit(items).associationRules
    found = found.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == _BAD))
    # FP-growth counts in shares of the rows that it was given.
    n = items.count()
    more = found.select("antecedent", "confidence", F.round(F.col("support") * n).cast("long").alias("bad")).filter(F.col("bad") >= least)
    joined = {r["all"][0]: frozenset(r["all"]) for r in _bounded(joint)}
    out = list(sure)
    for r in _bounded(more.orderBy(F.size("antecedent"), F.desc("bad"), F.array_join(F.array_sort("antecedent"), " "))):
        s = frozenset().union(*(joined[t] for t in r["antecedent"]))
        if not any(k.tokens <= s for k in out):  # shorter rules first: what one implies is not kept
            out.append(Rule(s, r["bad"], r["confidence"]))
    return out


def _bounded(rules: DataFrame) -> list:
    """Rules on the driver: an error, never a cut, if there are too many."""
    got = rules.limit(MAX_RULES + 1).collect()
    if len(got) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: raise min_support or min_confidence")
    return got


class Listed:
    """Listed (host, path, verdict) rules; a rule fits its host, all
    subdomains, and paths that start with its own.  The longest wins."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
        for place, (host, path, verdict) in enumerate(rules):
            self.by[host.lower()].append((path, verdict, place))
        for paths in self.by.values():
            paths.sort(key=lambda x: -len(x[0]))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict."""
        best, at = None, 0
        while at >= 0:
            suffix = host[at:]
            for p, verdict, place in self.by.get(suffix, ()):
                if path.startswith(p):
                    if best is None or (len(suffix) + len(p), -place) > best[0]:
                        best = (len(suffix) + len(p), -place), (suffix + p, verdict)
                    break
            at = host.find(".", at) + 1 or -1
        return best[1] if best else None


def judge(pages: DataFrame, listed: Sequence[tuple[str, str, str]], mined: Sequence[Rule], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``mined_rules``.

    ``verdict`` is that of the longest listed rule that fits; without one it is
    ``block`` if a mined rule fits, else ``allow``.
    """
    by_list, by_index = Listed(listed), Index(mined)
    kind = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("mined_rules", T.IntegerType())])

    @F.pandas_udf(kind)
    def of(host: pd.Series, path: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        out = []
        for h, p, t in zip(host, path, tokens, strict=True):
            rule, hits = by_list.match(h, p), by_index.match(t)
            out.append((rule[0] if rule else None, rule[1] if rule else "block" if hits else "allow", len(hits)))
        return pd.DataFrame(out, columns=["rule", "verdict", "mined_rules"]).astype({"rule": object, "verdict": object, "mined_rules": "int32"})

    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    name = fresh(parts, "_judged")
    judged = parts.withColumn(name, of("host", "path", tokens_of(F.col("host"), F.col("path"))))
    return judged.withColumns({c: F.col(name)[c] for c in ("rule", "verdict", "mined_rules")}).drop(name)


def listed_labels(pages: DataFrame, listed: Sequence[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Labels (url, label) from listed rules: 1 for urls that they block, 0 for
    urls that they allow; others have none."""
    judged = judge(pages.select(F.col(url).alias("url")), listed, [])
    return judged.filter("rule IS NOT NULL").select("url", (F.col("verdict") == "block").cast("int").alias("label"))


def seed_labels(pages: DataFrame, terms: Sequence[str], url: str = "url") -> DataFrame:
    """Labels (url, label) from a list of words: 1 for a url whose host has one
    of them.  A stand-in where no judged urls are at hand."""
    host = F.split(F.lower(host_of(F.col(url))), r"[^\p{L}\p{N}]+")
    return pages.select(F.col(url).alias("url"), F.arrays_overlap(host, F.array(*map(F.lit, terms))).cast("int").alias("label"))
