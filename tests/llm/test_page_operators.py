"""HTML extraction and URL rules: what the cut and the mined rules decide."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptrace.llm import extract, queries, urlfilter


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body class="no-sidebar has-menu"><article><p>One two three.</p><p>Four five</p></article></body>', "One two three. Four five"),
        ('<div class="search-results"><article><p>One two three.</p></article></div>', "One two three."),
        ("<article><p>One two.</p><p hidden>Hidden text.</p><p aria-hidden=true style='display:none'>Three</p></article>", "One two. Hidden text. Three"),
        ("<article><p>Let <math><mi>x</mi></math> be.</p><object>other text</object></article>", "Let x be. other text"),
        ('<form id="f"><div class="post"><p>Long text of an article goes here, yes.</p><p>Second sentence here.</p></div></form><footer>foot</footer>', "Long text of an article goes here, yes. Second sentence here."),
        ('<main><h1>T</h1><p>Real article text with many words in it.</p></main><section id="comments"><article><p>Nice one, I like it a lot, thanks.</p></article></section>', "T Real article text with many words in it."),
        ('<article><h1>T</h1><p>Text one is here.</p><div class="share">Share this: Twitter</div><p>Text two is here.</p><aside>Pull</aside><p>End.</p><footer>By me</footer></article>', "T Text one is here. Text two is here. End."),
        ('<article><header class="entry-header"><h1>Head</h1></header><p>Body text, long.</p><form><select><option>a</option></select></form></article>', "Head Body text, long."),
        ('<table><tr><td><a href=1>Home</a></td><td><a href=2>News</a></td></tr></table><h1>A title</h1><p>A long text that goes on for a while, really.</p><p>Short one</p><p>Another text here, with a stop.</p>', "A title A long text that goes on for a while, really. Short one Another text here, with a stop."),
        ("<p>&lt;b&gt; &amp;amp; &#233;&#xe9; &nbsp; x</p>", "<b> &amp; éé x"),
    ],
)
def test_pages(page, want):
    assert extract.main_text(page) == want


def test_the_cut_decides_where_a_threshold_errs():
    """A doubtful line amid an article stays, and a long line amid boilerplate
    goes: by their own odds both would be labelled wrongly."""
    amid = "<div><p>One long paragraph of the article, with many words.</p><p class='more'>Read on here</p><p>Another paragraph of it, with many words.</p></div>"
    p = extract.blocks(amid)
    odds, plain = extract.odds_of(p, extract.PRIOR)
    assert (odds > 0).tolist() == [True, False, True] and extract.label(p, odds, plain) == [True, True, True]
    links = "<ul>" + "<li><a href=x>Go</a></li>" * 3 + "<li>All of our other pages that are here and there.</li>" + "<li><a href=x>Go</a></li>" * 3 + "</ul>"
    p = extract.blocks(links + "<p>The text of the article itself, which is long enough.</p>")
    odds, plain = extract.odds_of(p, extract.PRIOR)
    assert 0 < odds[3] and extract.label(p, odds, plain) == [False] * 7 + [True]


def test_labels_are_the_least_cost():
    rng = np.random.default_rng(3)
    page = "<div>" + "".join(f"<p class='{c}'>{'w ' * n}</p>" + ("</div><div>" if cut else "") for c, n, cut in zip(rng.choice(["", "more", "ad"], 9), rng.integers(1, 9, 9), rng.random(9) < 0.3, strict=True)) + "</div>"
    p = extract.blocks(page)
    plain = extract.odds_of(p, extract.PRIOR)[1]
    for _ in range(20):
        odds = rng.normal(0, 2, len(p.text))
        net: dict = {}
        label = extract.label(p, odds, plain)

        class Spy(extract.Network):
            def edge(self, a, b, there, back=0.0):
                net[a, b] = net.get((a, b), 0) + there
                net[b, a] = net.get((b, a), 0) + back
                super().edge(a, b, there, back)

        real, extract.Network = extract.Network, Spy
        try:
            extract.label(p, odds, plain)
        finally:
            extract.Network = real
        n = len(odds)

        def cost(side, net=net, n=n):
            on = [*side, True, False]
            return sum(w for (a, b), w in net.items() if on[a] and not on[b])

        assert cost(label) == pytest.approx(min(cost(x) for x in itertools.product([False, True], repeat=n)))


def test_fit_learns_from_marked_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    w = extract.fit(pages)
    assert len(w) == len(extract.PRIOR) and np.abs(w - extract.PRIOR).max() > 0.05
    assert np.array_equal(extract.fit(pages.orderBy(F.rand(4)).repartition(3)).round(6), w.round(6))
    assert np.array_equal(extract.fit(pages.limit(0)), extract.PRIOR)
    # The mark is no feature: without it the fitted model gives the same text.
    unmarked = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    one, two = (extract.extract(x, w).select("page_id", "text") for x in (pages, unmarked))
    assert one.join(two.withColumnRenamed("text", "other"), "page_id").filter("text <> other").count() <= 0.01 * pages.count()
    # A plain sum over all blocks gives the same gradient: zero at the fitted weights.
    rows = [extract.describe(extract.blocks(r["html"])) for r in pages.collect()]
    x, y = np.concatenate([r[0] for r in rows if r[1].any() and not r[1].all()]), np.concatenate([r[1] for r in rows if r[1].any() and not r[1].all()])
    gradient = min(1.0, extract.EVIDENCE / len(y)) * x.T @ (1 / (1 + np.exp(-x @ w)) - y) + w - extract.PRIOR
    assert np.abs(gradient).max() < 1e-4


def test_deep_broken_and_long_pages():
    began = time.time()
    assert extract.main_text("<div>" * 100_000 + "<p>The text of it, at last.") == "The text of it, at last."
    for page in ("<div>a" * 50_000 + "</div>" * 50_000, "<div>" * 50_000 + "</span2></p>" * 50_000, '<div class="a>' * 20_000, "<" * 50_000):
        extract.main_text(page)
    long = "<article>" + "<p>one two three.</p>" * 100_000 + "</article>"
    assert extract.main_text(long) == " ".join(["one two three."] * 100_000)
    assert time.time() - began < 60


def test_extract_odd_rows(spark):
    page = "<nav><a href=x>Home</a></nav><article><p>Text of it.</p></article>"
    rows = [(1, None, "x", 5), (2, "", "x", 5), (3, page, "x", 5), (3, page, "x", 5), (None, page, None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, _text int")
    got = extract.extract(df)
    assert got.columns == ["page_id", "html", "text", "_text"]
    assert sorted(r["text"] for r in got.collect()) == ["", "", "Text of it.", "Text of it.", "Text of it."]
    assert extract.extract(df.limit(0)).count() == 0


def brute_rules(rows, least, confidence):
    """All combinations of tokens, counted one by one."""
    out = {}
    for size in range(1, 6):
        for s in {c for items, bad in rows if bad for c in itertools.combinations(sorted(items), size)}:
            n = [bad for items, bad in rows if set(s) <= items]
            if sum(n) >= least and sum(n) / len(n) >= confidence and not any(set(k) <= set(s) for k in out):
                out[s] = (sum(n), sum(n) / len(n))
    return out


def test_mined_supports_equal_a_count(spark):
    rng = np.random.default_rng(8)
    urls = []
    for _ in range(300):
        words = rng.choice(["win", "free", "shop", "news", "big", "day"], 3, replace=False)
        bad = {"win", "free"} <= set(words) or "shop" in words and rng.random() < 0.3
        urls.append((f"http://{'-'.join(words)}.example.com/{rng.choice(['en', 'de'])}/1", int(bad)))
    df = spark.createDataFrame([*urls, (None, 1), ("http://x.com", None)], "url string, label int")
    tokens = {r["url"]: set(r["t"]) for r in df.select("url", urlfilter.tokens_of(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))).alias("t")).collect()}
    rows = [(tokens[u], b) for u, b in urls]
    least = max(2, 0.02 * (sum(b for _, b in rows) + 1))
    got = {tuple(sorted(r.tokens)): (r.support, round(r.confidence, 9)) for r in urlfilter.mine(df)}
    want = {s: (n, round(c, 9)) for s, (n, c) in brute_rules(rows, least, 0.9).items()}
    assert got == want and any(len(s) > 1 for s in got)
    masked = urlfilter.mine(df, masked=["h:win"])
    assert not any("h:win" in r.tokens for r in masked)


def test_url_query_against_plain_python(spark):
    import re

    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have too few unwanted urls for a rule
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    mined = urlfilter.mine(urlfilter.listed_labels(pages, queries.URL_RULES))
    got = {r["page_id"]: r for r in queries.op2_url_rules(spark, sf_dir).collect()}
    assert mined
    for page_id, url in pages.collect():
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
        words = {f"h:{w}" for w in re.split(r"[\W_]+", host.lower()) if w} | {f"p:{w}" for w in re.split(r"[^\w#]+|_", re.sub(r"\d+", "#", path).lower()) if w}
        verdict = verdict or ("block" if any(r.tokens <= words for r in mined) else "allow")
        assert (got[page_id]["host"], got[page_id]["path"], got[page_id]["rule"], got[page_id]["verdict"]) == (host, path, rule, verdict)


def test_mined_rules_judge_hosts_that_were_held_out(spark):
    """Rules mined on some hosts block the bad ones among the others."""
    words, make = [f"c{k}" for k in range(12)], lambda a, b, k: f"http://{a}{k}.{b}.example.com/p/{k}"
    bad = [(make("a", f"casino-{w}", k), 1) for k, w in enumerate(words)]
    good = [(make("a", w, k), 0) for k, w in enumerate(words * 3)]
    mined = urlfilter.mine(spark.createDataFrame(bad[:8] + good[:24], "url string, label int"))
    rest = spark.createDataFrame(bad[8:] + good[24:], "url string, label int")
    got = urlfilter.judge(rest, [], mined).select("label", "verdict").collect()
    assert all((r["verdict"] == "block") == bool(r["label"]) for r in got)


def test_no_rule_is_lost_beside_many_tokens(spark):
    """A rule of two tokens beside fourteen that tell more each."""
    rows = []
    for k in range(4_000):
        bad = k % 2
        noise = [f"n{chr(97 + j)}" for j in range(14) if bad or (k // 2 + j) % 4 == 0]  # confidence 0.8 each
        pair = ["uu", "vv"] if bad else ["uu"] if k % 4 else ["vv"]
        rows.append((f"http://x.y/{'/'.join(noise + pair)}", bad))
    mined = urlfilter.mine(spark.createDataFrame(rows, "url string, label int"))
    assert any(r.tokens == {"p:uu", "p:vv"} and r.support == 2_000 and r.confidence == 1.0 for r in mined)


def test_tokens_that_always_occur_together_are_one_item(spark):
    word = lambda j: f"t{chr(97 + j // 8)}{chr(97 + j % 8)}"  # noqa: E731  digits would all be one token
    many = "/".join(word(j) for j in range(60))
    rows = [(f"http://x.y/{many}/bad", 1)] * 5 + [(f"http://x.y/{many}", 0), ("http://x.y/bad", 0)] * 3
    mined = urlfilter.mine(spark.createDataFrame(rows, "url string, label int"))
    assert [(len(r.tokens), r.support, r.confidence) for r in mined] == [(61, 5, 1.0)]
    free = [(f"http://x.y/{'/'.join(word(j) for j in range(40) if j != k)}", k % 2) for k in range(40)]
    with pytest.raises(ValueError, match="min_support"):
        urlfilter.mine(spark.createDataFrame(free, "url string, label int"))


def test_rules_mined_from_listed_ones_judge_held_out_urls(spark):
    """The listed rules' verdicts on pages that were not learned from."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    held = F.crc32(F.col("page_id").cast("string")) % 4 == 2
    mined = urlfilter.mine(urlfilter.listed_labels(pages.filter(~held), queries.URL_RULES))
    truth = urlfilter.listed_labels(pages.filter(held), queries.URL_RULES).distinct()
    got = urlfilter.judge(truth, [], mined).groupBy("label", "verdict").count().collect()
    n = {(r["label"], r["verdict"]): r["count"] for r in got}
    right, wrong = n.get((1, "block"), 0), n.get((0, "block"), 0)
    # com/en/ has too many exceptions for a rule of confidence 0.9: what is found is org/es/.
    assert right / (right + n.get((1, "allow"), 0)) > 0.25 and right / (right + wrong) > 0.85


def test_of_equal_rules_the_first_listed_wins():
    assert urlfilter.Listed([("com", "/x/y", "allow"), ("a.com", "/x", "block")]).match("a.com", "/x/y") == ("com/x/y", "allow")
    assert urlfilter.Listed([("a.com", "/x", "block"), ("com", "/x/y", "allow")]).match("a.com", "/x/y") == ("a.com/x", "block")
    assert urlfilter.Listed([("com", "/x/y/", "allow"), ("a.com", "/x", "block")]).match("b.a.com", "/x/y/") == ("com/x/y/", "allow")


def test_url_odd_rows(spark):
    rows = [(1, "http://a.casino.com/x" + "y" * 100_000, "k", "m", "n"), (1, None, "k", "m", "n"), (1, "http://a.casino.com/", "k", "m", "n")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, _judged string, host string, mined_rules string")
    got = urlfilter.judge(df, [("casino.com", "/", "block"), ("casino.com", "/", "allow")], [])
    assert sorted(got.columns) == sorted([*df.columns, "path", "rule", "verdict"]) and got.filter("_judged = 'k'").count() == 6
    assert sorted(r["verdict"] for r in got.collect()) == ["allow"] * 2 + ["block"] * 4  # the first of equal rules
    assert urlfilter.judge(df.limit(0), [], []).count() == 0
