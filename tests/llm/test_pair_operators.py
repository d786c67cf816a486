"""Near-duplicates, decontamination, WARC, components and the pipeline:
against brute force, and on awkward rows."""

from __future__ import annotations

import gzip
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from cliptrace.llm import common, decontam, embdedup, graph, langid, quality, queries, simhash, warc


def union(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    n = 400
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(300)] + [(0, k) for k in range(300, 340)] + [(k, k + 1) for k in range(100, 160)]
    want = union(n, pairs)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([*pairs, (None, 3), (4, 4)], "a long, b long")).collect()}
    assert got == {i: want[i] for i in range(n) if any(i in p and p[0] != p[1] for p in pairs)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for t in [None, "", " \n", "a", "A b C", "one two three four", "É é Ä one\x0btwo\x0cthree four five", "x " * 50_000, "a b c d e f"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_simhash_against_brute_force(spark, sf_dir):
    got = queries.op4_simhash(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, union(len(ids), pairs), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_simhash_finds_all_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 40, np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4, 40), np.uint64)) for _ in range(12)]))
    monkeypatch.setattr(simhash, "UNIT_ROWS", 16)  # groups are cut into chunks
    prints = spark.createDataFrame([(i, int(f.view(np.int64))) for i, f in enumerate(fps)], "rep long, fp long")
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 4]
    want = union(len(fps), pairs)
    got = [(r["a"], r["b"]) for r in simhash.links(prints).collect()]
    assert all(int(fps[a] ^ fps[b]).bit_count() > 0 for a, b in got)
    assert union(len(fps), got) == want


@pytest.mark.parametrize("rows", [100, 10**7, 10**12])
def test_blocks_lose_no_pair(rows):
    masks = simhash.block_choices(rows)
    rng = random.Random(1)
    for _ in range(500):
        diff = sum(1 << k for k in rng.sample(range(64), 4))
        assert any(diff & m == 0 for m in masks)


def test_simhash_odd_rows(spark):
    rows = [(5, None, 1, "x"), (2, "", 1, "x"), (9, "a b c d e", 1, "x"), (3, "a b c d e", 1, "x"), (3, "a b c d e", 1, "x"), (None, "a b c d e", 1, "x"), (7, "zz " * 3000, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, _key string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect() if r["doc_id"] is not None)
    assert [(a, b) for _, a, b in got] == [(2, 2), (3, 3), (3, 3), (5, 2), (7, 7), (9, 3)]
    assert simhash.near_duplicates(df).filter("doc_id IS NULL AND component_id IS NULL").count() == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, 32))
    near = np.concatenate([base[:20] + 0.12 * rng.standard_normal((20, 32)) for _ in range(6)])
    return np.concatenate((base, near, base[:5], base[:3] * 2.0)).astype(np.float32)


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "UNIT_ROWS", 16)
    v = vectors()
    odd = [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, [None, *[1.0] * 31]), (1004, [1.0, 2.0]), (1005, []), (1006, [float("inf")] * 32)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "vec_id long, embedding array<float>").withColumn("w", F.lit("clash")).withColumn("sig", F.lit(1))
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(df).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    link = (u @ u.T) >= 0.9
    np.fill_diagonal(link, False)
    pairs = [(a, b) for a, b in zip(*np.nonzero(link), strict=True) if a > b]
    found = sum(got[i]["n_links"] for i in range(len(v)))
    assert 0.95 <= found / link.sum() <= 1
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(v)))
    assert [got[i]["component_id"] for i in range(len(v))] == union(len(v), pairs)
    for i, _ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def items():
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(400)]
    return vocab, [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 40)))) for k in range(60)]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_decontamination_recall_and_exactness():
    vocab, bench = items()
    rng = random.Random(4)
    searcher = decontam.Searcher(bench, 0.8, 5, 4, 8, 3, 3)
    texts, planted = [], []
    for _ in range(400):
        k, text = rng.choice(bench)
        w = text.split()
        for _ in range(rng.randint(0, int(0.2 * len(w)))):
            p, kind = rng.randrange(len(w)), rng.random()
            w[p : p + (kind < 0.7)] = [rng.choice(vocab)] if kind < 0.5 or kind >= 0.7 else []
        pad = [f"z{rng.randrange(999)}" for _ in range(30)]
        texts.append(" ".join(pad[:15] + [x.upper() + "," for x in w] + pad[15:]))
        planted.append(k)
    found = searcher.search(texts)
    assert sum(k in {m[0] for m in f} for k, f in zip(planted, found, strict=True)) >= 0.98 * len(texts)
    by_id = dict(bench)
    for t, f in zip(texts, found, strict=True):
        w = decontam.words(t)
        for k, d, size, a, b in f:
            want = by_id[k].split()
            assert size == len(want) and edit(want, w[a:b]) == d <= 0.2 * size
    assert searcher.search([" ".join(f"z{k}" for k in range(500)), None, "", " , ; "]) == [[], [], [], []]


def edited(rng, words, k, kind, other):
    """``words`` with exactly ``k`` edits of one kind."""
    w = list(words)
    if kind == "insert":
        for p in sorted((rng.randrange(1, len(w)) for _ in range(k)), reverse=True):
            w.insert(p, other())
        return w
    for p in sorted(rng.sample(range(len(w)), k), reverse=True):
        w[p : p + 1] = [other()] if kind == "substitute" else []
    return w


@pytest.mark.parametrize("size", [15, 25, 40, 59, 120])
def test_decontamination_recall_at_all_allowed_edits(size):
    rng = random.Random(size)
    bench = [(k, " ".join(f"w{x}" for x in rng.sample(range(5_000), size))) for k in range(12)]
    for recall in (0.99, 1.0):
        searcher = decontam.Searcher(bench, 0.8, 5, 4, 8, 3, 3, recall)
        for kind in ("substitute", "insert", "delete"):
            texts = []
            for i in range(240):
                pad = [f"w{rng.randrange(5_000)}" for _ in range(60)]
                w = edited(rng, bench[i % 12][1].split(), size // 5, kind, lambda: f"w{rng.randrange(5_000)}")
                texts.append(" ".join(pad[:30] + w + pad[30:]))
            found = sum(i % 12 in {m[0] for m in f} for i, f in enumerate(searcher.search(texts)))
            assert found >= recall * len(texts), (kind, found)


def test_walks_are_added_until_sampling_reaches_the_recall(sf_dir):
    """No item of the tables is searched for without sampling, and at exactly
    the allowed edits as many are found as the target says."""
    rows = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    bench = list(zip(rows.item_id.tolist(), rows.text.tolist(), strict=True))
    searcher = decontam.Searcher(bench, 0.8, 1, 4, 8, 2, 3, 0.99)
    assert all(4 <= g.walks <= decontam.MAX_WALKS and g.holders is None for g in searcher.groups)
    lax = decontam.Searcher(bench, 0.8, 1, 1, 8, 2, 3, 0.5)
    assert all(a.walks < b.walks for a, b in zip(lax.groups, searcher.groups, strict=True))
    rng = random.Random(8)
    vocab = sorted(searcher.vocabulary)
    for kind in ("substitute", "insert", "delete"):
        texts, planted = [], []
        for item, text in bench:
            w = decontam.words(text)
            for _ in range(3):
                pad = [rng.choice(vocab) for _ in range(60)]
                texts.append(" ".join(pad[:30] + edited(rng, w, int(0.2 * len(w) + 1e-9), kind, lambda: rng.choice(vocab)) + pad[30:]))
                planted.append(item)
        found = sum(k in {m[0] for m in f} for k, f in zip(planted, searcher.search(texts), strict=True))
        assert found >= 0.99 * len(texts), (kind, found, len(texts))


def test_decontamination_without_sampling_finds_what_brute_force_does(monkeypatch):
    monkeypatch.setattr(decontam, "SHARED_PAIRS", 50)  # many small parts
    vocab, _ = items()
    rng = random.Random(2)
    bench = [(k, " ".join(rng.choice(vocab[:9]) for _ in range(rng.choice([6, 10, 11])))) for k in range(12)]
    texts = [" ".join(rng.choice(vocab[:9]) for _ in range(30)) for _ in range(60)]
    texts += [" ".join(edited(rng, bench[i % 12][1].split(), 1, "delete", None)) for i in range(24)]
    found = decontam.Searcher(bench, 0.8, 5, 4, 8, 3, 3, 1.0).search(texts)
    want = set()
    for i, t in enumerate(texts):
        w = t.split()
        for k, b in bench:
            b, most = b.split(), int(0.2 * len(b.split()))
            spans = (w[a : a + n] for n in range(len(b) - most, len(b) + most + 1) for a in range(max(len(w) - n + 1, 0)))
            if any(edit(b, x) <= most for x in spans):
                want.add((i, k))
    assert want and {(i, m[0]) for i, f in enumerate(found) for m in f} == want


def test_decontamination_odd_rows(spark, monkeypatch):
    vocab, bench = items()
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, bench[0][1], 1), (3, bench[0][1], 1), (4, "x " * 20_000 + bench[1][1], 1)], "doc_id long, text string, matches int")
    b = spark.createDataFrame([*bench, bench[0], (99, None), (98, ""), (97, "too short"), (None, bench[2][1])], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.matches(df, b).collect())
    assert got == [(3, 0, 0), (3, 0, 0), (4, 1, 0)]
    assert sorted(r["doc_id"] for r in decontam.clean(df, b).collect()) == [1, 2]
    assert decontam.matches(df, b.limit(0)).count() == 0 and decontam.matches(df.limit(0), b).count() == 0
    monkeypatch.setattr(decontam, "MAX_ITEM_BYTES", 2_000)  # several passes
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.matches(df, b).collect()) == got


def test_verbatim_passages_of_the_tables(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    norm = lambda t: " " + " ".join(decontam.words(t)) + " "
    texts = {r["doc_id"]: norm(r["text"]) for r in docs}
    want = {(d, r["item_id"]) for r in bench for d, t in texts.items() if norm(r["text"]) in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_decontamination(spark, sf_dir).collect()}
    assert want and want <= got


def test_warc_of_one_gzip_member_per_record(spark, tmp_path):
    record = lambda k: f"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <{k}>\r\nContent-Length: 4\r\n\r\na: {k}\r\n\r\n".encode()
    packed = b"".join(gzip.compress(record(k)) for k in range(5))
    (tmp_path / "a.warc.gz").write_bytes(packed)
    assert sorted(r["record_id"] for r in warc.read(spark, str(tmp_path)).collect()) == [f"<{k}>" for k in range(5)]
    whole = record(1) + record(2)
    assert len(list(warc.parse(whole))) == 2
    for short in (whole[:-6], whole[: len(record(1)) + 20]):
        with pytest.raises(ValueError, match="truncated"):
            list(warc.parse(short))
    with pytest.raises(ValueError, match="truncated"):
        warc.unpack(packed[:-12])
    big = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % (50 << 20) + b"x" * (50 << 20) + b"\r\n\r\n" + record(7)
    found = list(warc.records(warc.inflate(gzip.compress(big, 1) + packed)))
    assert len(found) == 7 and len(found[0][1]) == 50 << 20 and found[1][0]["warc-record-id"] == "<7>"


def test_long_pages_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_BYTES", 100)
    monkeypatch.setattr(warc, "PAGES_PER_FILE", 4)
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("x"), (F.col("id") * 9).cast("int")).alias("html")).coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "w")).select("path", "content").collect()
    held = [(f["path"], sum(len(b) for h, b in warc.records(warc.inflate(bytes(f["content"]))) if h["warc-type"] == "response")) for f in files]
    assert max(n for _, n in held) <= 4 * 100 + 4 * 200 and sum(1 for p, _ in held if "level=3" in p) >= 15
    got = warc.resolve(warc.captures(spark, str(tmp_path / "w"), payloads=False)).collect()
    assert sorted((int(r["key"]), r["payload_bytes"]) for r in got) == [(k, 9 * k) for k in range(60)]


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 40
    rows = [(4, "http://a/\r\nX: y", long), (2, "http://b", long), (9, None, long), (2, "http://b", long), (1, "http://c", None), (3, "http://d", ""), (8, "http://e", "short"), (7, "http://e", "short"), (None, "http://n", "z" * 300), (5, "u", "z" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("row", F.lit("x"))
    warc.write(pages, str(tmp_path / "w"))
    found = warc.captures(spark, str(tmp_path / "w")).collect()
    assert len(found) == len(rows)
    assert all(len(c["requests"]) == 1 and len(c["metadata"]) == 1 for c in found)
    payloads = sorted(bytes(c["payload"]).decode() for c in found if c["record_type"] == "response")
    assert payloads == sorted(["", "", "short", "short", long, "z" * 300])
    got = warc.resolve(warc.captures(spark, str(tmp_path / "w"), payloads=False)).collect()
    kinds = sorted((c["key"] or "-", c["record_type"], c["refers_to_key"] or "-", c["payload_bytes"]) for c in got)
    n = len(long.encode())
    assert [k for k in kinds if k[3] == n] == [("2", "response", "-", n), ("2", "revisit", "2", n), ("4", "revisit", "2", n), ("9", "revisit", "2", n)]
    assert [k[1] for k in kinds if k[3] == 300] == ["revisit", "response"] and [k[1] for k in kinds if k[3] == 5] == ["response"] * 2
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.captures(spark, str(tmp_path / "e")).count() == 0


def test_warc_query_with_null_and_odd_keys(spark, tmp_path):
    rows = [(None, "http://n\t\x01\x7f", "z" * 300), (5, "http://a/\tb", "z" * 300), (None, None, None), (6, "u", "short")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op8_warc(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == [(0, "response", None, 0), (0, "revisit", 5, 300), (5, "response", None, 300), (6, "response", None, 5)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    urls = {r["target_uri"] for r in warc.captures(spark, str(tmp_path / "w")).collect()}
    assert urls == {"http://n%09%01%7F", "http://a/%09b", None, "u"}


def test_items_of_one_word_alone_are_found(spark):
    docs = spark.createDataFrame([(1, "say hello world"), (2, "nothing"), (3, None), (4, "Hello, hello!")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "hello")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.matches(docs, bench).select("doc_id", "item_id", "distance", "start_word", "end_word").collect())
    assert got == [(1, 7, 0, 1, 2), (4, 7, 0, 0, 1)]
    assert decontam.Searcher([(7, "hello")], 0.8, 1, 4, 8, 2, 3).search(["say hello world"]) == [[(7, 0, 1, 1, 2)]]


def test_similarities_that_could_lose_items_are_refused():
    item = [(1, " ".join(f"w{k}" for k in range(12)))]
    with pytest.raises(ValueError, match="similarity"):
        decontam.Searcher(item, 0.5, 1, 4, 8, 2, 3, 1.0)
    assert decontam.Searcher(item, 0.8, 1, 4, 8, 2, 3, 1.0).groups[0].edits == 2


def test_near_duplicate_stage_against_brute_force(spark, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(simhash, "UNIT_ROWS", 16)  # groups in several units
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(3_000)]
    texts = [None, "", " \n", "a b", "A  B", "one two three", "one two three four"]
    for n in (12, 60, 200, 600):
        for _ in range(6):
            base = [rng.choice(vocab) for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (0.005, 0.01, 0.02, 0.05):
                w = list(base)
                for p in rng.sample(range(n), max(1, round(edits * n))):
                    w[p] = rng.choice(vocab)
                texts.append(" ".join(w))
    texts += [texts[-1].upper()] * 20 + [texts[40] + f" end{k}" for k in range(30)]
    fps = [brute_fingerprint(t, 5) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 6]
    assert sum(fps[a] != fps[b] for a, b in pairs) > 30
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == sorted(set(union(len(texts), pairs)))


def plain_quality(model, text):
    """Features, ridge score and calibration of one text, number by number."""
    x = quality.statistics([text])[0]
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    each = [math.sqrt(2 / quality.FEATURES) * math.cos(sum(a * b for a, b in zip(z, model.directions[:, k], strict=True)) + model.phases[k]) for k in range(quality.FEATURES)]
    raw = sum(a * b for a, b in zip([*each, 1.0], model.weights, strict=True))
    return float(np.interp(raw, model.knots, model.values))


def plain_language(model, text):
    """Word by word: its own row, else those of its longest known n-grams."""
    found = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(c.isalpha() for c in w)]
    if not found:
        return "und", 0.0
    total = np.zeros(len(model.languages))
    for w in found:
        rows = [model.words[w]] if w in model.words else next((r for n, table in zip(range(len(model.grams), 0, -1), model.grams, strict=True) if (r := [table[g] for g in langid.grams(w, n) if g in table])), [])
        if rows:
            total += sum(model.rows[k] for k in rows) / len(rows)
    n = len(found)
    odds = model.prior + total * (min(n, 30) / n)
    best = int(np.argmax(model.prior / n + total / n))
    return model.languages[best], float(1 / np.exp(odds - odds[best]).sum())


def plain_items(bench, text):
    """Items of which the text holds a passage: an edit distance free at both
    ends of the text, for every item."""
    w, out = decontam.words(text or ""), set()
    for item, words in bench:
        v = decontam.words(words or "")
        most = int(0.2 * len(v) + 1e-9)
        if not v or len(set(w) & set(v)) < len(set(v)) - most:
            continue
        row = [0] * (len(w) + 1)
        for i, x in enumerate(v, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(w, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) <= most:
            out.add(item)
    return out


def test_decontamination_query_against_all_windows(spark, sf_dir):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_decontamination(spark, sf_dir).collect()}
    assert got == {(d["doc_id"], k) for d in docs for k in plain_items(bench, d["text"])}


def test_short_and_unspaced_items():
    bench = [(1, "Photosynthesis"), (2, "red herring"), (3, "what is love"), (4, "人工智能改变世界"), (5, "")]
    searcher = decontam.Searcher(bench, 0.8, 1, 4, 8, 3, 3)
    texts = ["On photosynthesis, again: photosynthesis.", "a red, Herring", "red big herring", "so What is love?", "我们认为人工智能改变世界的方式", "人工智慧改变世界吗", "人工", None]
    assert [sorted(m[0] for m in f) for f in searcher.search(texts)] == [[1], [2], [], [3], [4], [4], [], []]


def test_ridge_equals_a_direct_solve(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string")) % 5 == 4
    model = quality.fit(docs, labels, calibrate=apart)
    rows = docs.join(labels, "doc_id").select("text", "quality", apart.alias("apart")).collect()
    x, y, away = quality.statistics([r["text"] for r in rows]), np.array([r["quality"] for r in rows], float), np.array([r["apart"] for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) < 1e-6, 1, x.std(axis=0)))
    z = model.features(x)
    fit = z[~away]
    want = np.linalg.lstsq(np.vstack((fit, math.sqrt(quality.PENALTY) * np.eye(fit.shape[1]))), np.concatenate((y[~away], np.zeros(fit.shape[1]))), rcond=None)[0]
    assert np.allclose(fit @ model.weights, fit @ want, atol=1e-4)
    assert [plain_quality(model, r["text"]) for r in rows[:20]] == pytest.approx(quality.score(docs.join(labels, "doc_id").select("text").limit(0).union(spark.createDataFrame([(r["text"],) for r in rows[:20]], "text string")), model).toPandas()["score"].tolist())


def test_language_query_against_plain_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = queries.language_model(docs.select("doc_id", "text", "lang"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op3_language(spark, sf_dir).collect():
        lang, p = plain_language(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(p, abs=1e-9)


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "some text", "a", "b", "c", "d")], "doc_id long, text string, _language string, _matches0 string, _source string, _found string")
    bench = spark.createDataFrame([(1, "some other text of it")], "item_id long, text string")
    model = langid.fit(spark.createDataFrame([(1, "some text", "en"), (2, "anderer text", "de")], "doc_id long, text string, lang string"))
    for got in (langid.identify(df, model), decontam.find(df, bench), decontam.clean(df, bench)):
        r = got.first()
        assert [r[c] for c in ("_language", "_matches0", "_source", "_found")] == ["a", "b", "c", "d"]


def test_no_shared_folder_is_an_error_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(fake)


def test_pipeline_stage_by_stage(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("_row", F.lit("clash")).withColumn("_score", F.lit(1))
    left = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, sf_dir).cache()
        assert left.columns == docs.columns, name
        assert left.exceptAll(before).count() == 0 and 0 < left.count() <= before.count()
        if name == "near_duplicates":
            fps = {r["doc_id"]: brute_fingerprint(r["text"], 5) for r in before.collect()}
            ids = sorted(fps)
            comp = union(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 6])
            assert sorted(r["doc_id"] for r in left.collect()) == sorted({ids[c] for c in comp})
        if name == "quality":
            model = queries.quality_model(before.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
            want = {r["doc_id"] for r in before.collect() if plain_quality(model, r["text"]) >= 0.3}
            assert {r["doc_id"] for r in left.collect()} == want
        if name == "language":
            model = queries.language_model(before.select("doc_id", "text", "lang"))
            said = {r["doc_id"]: plain_language(model, r["text"]) for r in before.collect()}
            assert {r["doc_id"] for r in left.collect()} == {k for k, (lang, p) in said.items() if lang != "und" and p >= 0.5}
        if name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in before.collect() if not plain_items(bench, r["text"])}
    out = pipeline.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in left.select("doc_id").collect())


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.unionByName(docs.limit(2)).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6, None, None, None, None)], docs.schema))
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd, sf_dir).count() > 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
