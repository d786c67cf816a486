"""Filter audit against plain loops over the orders, and on awkward rows."""

from __future__ import annotations

import itertools
import re

import pytest

from cliptrace.llm import audit, queries

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """The letters that each row (id, lang, text) fails."""
    out = []
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, _, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        f |= {"A"} if len(w) < 100 else set()
        f |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and least[t] < i else set()
        out.append(f)
    return out


def brute(rows, labels):
    """Applies every order to every row, one filter after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed, out = fails(rows), []
    for part in {r[1] or "" for r in rows}:
        mine = [(i, f) for (i, lang, _), f in zip(rows, failed, strict=True) if (lang or "") == part]
        found, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = list(mine), []
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + hit
                total[f] += len(hit)
                found.append((part, "".join(order), step, len(left), len(hit), redundant, sum(x[1] == {f} for x in mine), sum(x[0] in good for x in hit), sum(x[0] in toxic for x in hit), f))
        out += [(*x[:-1], total[x[-1]]) for x in found]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_against_loops(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(queries.op13_filter_audit(spark, sf_dir)) == brute(rows, labels)


ROWS = [
    (1, "en", "a B"), (5, "en", "a B"), (5, "en", "a B"), (5, "fr", "a B"), (2, None, "a B"), (None, "en", "a B"), (None, None, None), (7, "", None), (8, "de", ""), (9, "de", " \t\n"),
    (10, "en", "w " * 5_000), (11, "en", " ".join(f"w{k}" for k in range(120))), (12, "en", " ".join(f"w{k}" for k in range(120))), (13, "en", " ".join(f"W{k}#" for k in range(120))), (14, "fr", "\x0bÉ\x0cÉ"),
    (1, "de", "other"), (15, "en", "\U0001f600" * 20 + "AB"), (16, "en", "\U0001f600" * 20 + "ABC"),
]
LABELS = [(1, 1, 0), (5, 1, 1), (5, 0, None), (2, None, 1), (10, 1, 1), (None, 1, 1), (99, 1, 1), (16, 1, 0)]


@pytest.mark.parametrize("held", [0, 64 << 20])
def test_odd_rows(spark, monkeypatch, held):
    monkeypatch.setattr(audit, "HELD_BYTES", held)  # 0: every row is sent on at once
    monkeypatch.setattr(audit, "SLICE_BYTES", 64)
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, lang string, text string, quality int, part string").repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert got(audit.audit(docs, labels)) == brute(ROWS, LABELS)
    assert got(audit.audit(docs, labels.limit(0))) == brute(ROWS, [])
    assert audit.audit(docs.limit(0), labels).collect() == []


def test_collisions_are_told_by_text(spark, monkeypatch):
    docs = spark.sparkContext.parallelize([(k, "en", f"text {k % 7}") for k in range(70)], 6)
    parts = {}
    for _, (part, mask, n) in audit.masks(docs, 4).collect():
        parts[mask & audit.DUPLICATE] = parts.get(mask & audit.DUPLICATE, 0) + n
    assert parts == {0: 7, audit.DUPLICATE: 63}
    chain = {}
    for i in (3, 1, 2):  # one fingerprint, two texts
        for raw in (b"x", b"y"):
            list(audit._meet(chain, raw, (i, 0, {"en": 1})))
    assert {raw: h[0] for raw, h in chain.items()} == {b"x": 1, b"y": 1}


def test_words_are_counted_over_slices(monkeypatch):
    raw = b"one two\x0bthree one " * 50
    whole = audit.count_words(raw)
    for size in (1, 7, 64):
        monkeypatch.setattr(audit, "SLICE_BYTES", size)
        assert audit.count_words(raw) == whole == (200, 3)
