"""Tokenizers, language, quality, HTML, URLs: against libraries, brute force,
held-out accuracy, and awkward rows."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliptrace.llm import bpe, extract, langid, quality, queries, tokencount, urlfilter

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "\n", "a", "A b", "  lead", "trail  ", "x \n y\n\n  z ", "été  çà 日本語 🎉🎉", "don't we'll", "▁ x▁▁y", "<s> </s> <0x0A>", "\x00a\x00", "1234 567", "a" * 3000, "word " * 5000, "é" * 200]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows: nulls, repeats, and columns with names that clash."""
    rows = [(i, t, "en", -1.0, "x", 7, [1]) for i, t in enumerate(ODD)] + [(None, "null id here", None, None, None, None, None), (0, None, "en", 0.0, "x", 7, [1])] + [(3, "  ", "fr", 0.0, "x", 7, [1])] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, fp string, n_tokens int, ids array<int>")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, odd, encoding):
    got = queries.digests(bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN)).collect()
    assert len(got) == odd.count()
    for r in got:
        text = r["text"] or ""
        want = encoding.encode_ordinary(text)
        assert list(r["ids"]) == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_encode_then_decode(spark, odd, encoding):
    coded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    assert bpe.encode(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    for r in bpe.decode(coded, RANKS).collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té日1'.st  ", max_size=40), max_size=6))
def test_bpe_any_text(texts):
    encoder = _encoder()
    flat, n = encoder[0].encode(texts)
    parts = np.split(flat, np.cumsum(n)[:-1]) if texts else []
    assert [p.tolist() for p in parts] == [encoder[1].encode_ordinary(t) for t in texts]


_made: list = []


def _encoder():
    if not _made:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        table = bpe.MergeTable(ranks)
        _made[:] = [bpe.Encoder(table, public_tokenizers.PATTERN, cache=50), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})]
    return _made


def test_token_counts_equal_library(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in tokencount.count_tokens(odd, PIECES).collect():
        assert r["n_tokens"] == len(sp.encode(r["text"] or "")), r["text"]
    assert tokencount.count_tokens(odd.limit(0), PIECES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab  \n▁éя日1'.stion", max_size=120))
def test_token_count_any_text(text):
    if not hasattr(test_token_count_any_text, "both"):
        raw = open(PIECES, "rb").read()
        test_token_count_any_text.both = tokencount.Counter(tokencount.PieceModel(raw)), sentencepiece.SentencePieceProcessor(model_proto=raw)
    counter, sp = test_token_count_any_text.both
    assert counter.count([text])[0] == len(sp.encode(text))


def test_queries_cover_all_rows(spark, sf_dir, encoding):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op5_byte_bpe(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    assert all(r["n_tokens"] == len(encoding.encode_ordinary(docs[r["doc_id"]])) for r in got)
    counts = queries.op7_token_counts(spark, sf_dir).collect()
    assert all(r["n_bytes"] == len(docs[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 4096) for r in counts)


def test_language_held_out(spark):
    got = queries.op3_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_odd_rows(spark, odd, sf_dir):
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    empty = langid.fit(odd.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_language_backoff_is_word_first():
    model = langid._model(["de", "en"], {"de": 5, "en": 5}, [("de", "der", 9), ("de", "undkeit", 4), ("en", "the", 9), ("en", "nation", 4)], 100, 5)
    assert model.parts("the") == [model.words["the"]]
    assert len(model.parts("keit")) > 0 and model.parts("keit")[0] not in model.words.values()
    assert model.parts("日") == []


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95


def test_quality_odd_rows(spark, odd, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    noisy = labels.unionByName(labels.limit(3)).unionByName(labels.selectExpr("doc_id", "CAST(NULL AS INT) AS quality", "toxic"))
    model = quality.fit(docs, noisy)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    untrained = quality.fit(docs, labels.limit(0))
    assert quality.score(odd, untrained).filter("score IS NULL").count() == 0


def test_isotonic_is_the_least_squares_monotone_fit():
    knots, values = quality.isotonic(np.array([3.0, 1, 2, 4]), np.array([0.0, 0, 1, 1]))
    assert knots.tolist() == [1, 2, 3, 4] and values.tolist() == [0, 0.5, 0.5, 1]
    x = np.random.default_rng(0).standard_normal(300)
    knots, values = quality.isotonic(x, (x > 0).astype(float))
    assert (np.diff(values) >= 0).all() and values[0] == 0 and values[-1] == 1


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div id="top-nav"><a href=x>Home</a> <a href=y>News</a></div><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies. Accept.</div><div class="post"><h2>Head line</h2><p>First para with some&nbsp;words in it, yes &amp; more.</p>
<div class="advert">Buy now!</div><p>Second one is <b>bold</b> text here.</p><ul><li>one point</li><li>two point</li></ul></div>
<aside><p>Read this other long text that stands in the side bar and is quite long indeed.</p></aside>
<section id="comments"><p>Nice article, I liked it very much, thanks.</p></section><form><label>Name</label><input></form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE) == "Head line First para with some words in it, yes & more. Second one is bold text here. one point two point"
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<div") == ""
    assert extract.main_text("plain text that is only here.") == "plain text that is only here."
    assert extract.main_text("<article><p>a < b and c > d</p><script>var t='</p>';</script><p>cut &am") == "a < b and c > d cut &am"


def test_main_text_is_the_article(spark, sf_dir):
    import html
    import re

    for r in queries.op6_main_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split()) and r["n_chars"] == len(r["text"])


def test_max_flow_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = 6
        unary, w = rng.normal(0, 2, n), np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.5), 1)
        net = extract.Network(n)
        for i in range(n):
            net.edge(n, i, max(unary[i], 0))
            net.edge(i, n + 1, max(-unary[i], 0))
            for j in range(i + 1, n):
                if w[i, j]:
                    net.edge(i, j, w[i, j], w[i, j])
        cost = lambda lab: sum(max(u, 0) * (not b) + max(-u, 0) * b for u, b in zip(unary, lab, strict=True)) + sum(w[i, j] for i in range(n) for j in range(i + 1, n) if lab[i] != lab[j])  # noqa: E731, B023
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(net.source_side(n, n + 1)[:n]) - best) < 1e-9


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.com/en/700?q", "a.example.com", "/en/700", "example.com/en/7", "allow"),
        ("http://example.com/en/8#x", "example.com", "/en/8", "com/en/", "block"),
        ("https://x.example.net/de/81", "x.example.net", "/de/81", "example.net/de/8", "block"),
        ("https://other.net/de/8", "other.net", "/de/8", "net/de/", "allow"),
        ("ftp://notcom/en/", "notcom", "/en/", None, "allow"),
        ("http://a.org", "a.org", "", None, "allow"),
        ("http://spam-farm.example.org/xx?a=://b", "spam-farm.example.org", "/xx", None, "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    mined = [urlfilter.Rule(frozenset({"h:spam"}), 5, 1.0)]
    df = spark.createDataFrame([(1, url, "x", "y")], "page_id long, url string, rule string, verdict string")
    r = urlfilter.judge(df, queries.URL_RULES, mined).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_url_mining(spark):
    rows = [(f"http://m{i}.casino-win.example.com/en/{i}", 1) for i in range(20)] + [(f"http://win{i}.example.com/en/{i}", 0) for i in range(60)] + [(None, 1), ("x", None)]
    rules = urlfilter.mine(spark.createDataFrame(rows, "url string, label int"))
    assert rules and all(r.confidence >= 0.9 and r.support >= 2 for r in rules)
    assert frozenset({"h:casino"}) in {r.tokens for r in rules}
    assert not any(r.tokens <= {"h:example", "h:com", "p:en", "p:#"} for r in rules)
    assert urlfilter.mine(spark.createDataFrame([], "url string, label int")) == []
    index, brute = urlfilter.Index(rules), lambda t: sorted(i for i, r in enumerate(rules) if r.tokens <= set(t))
    for tokens in (["h:casino", "h:com"], ["h:win", "h:casino", "p:en"], []):
        assert index.match(tokens) == brute(tokens)
