"""Toxicity: features against plain loops, learning, held-out labels, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np

from cliptrace.llm import queries, toxicity

CLEAN = "the river runs over flat stones near our old town and people walk there on warm evenings with their dogs".split()


def test_bag_is_the_mean_of_word_means():
    text = "One two, two THREE! --- ü\U0001f600x"
    found = [w for some in toxicity.words(text) for w in some]
    assert found == ["one", "two", "two", "three", "ü\U0001f600x"]
    want = {}
    for w in found:
        which = toxicity.subwords([w])[1]
        for b in which.tolist():
            want[b] = want.get(b, 0.0) + 1 / len(which) / len(found)
    ids, weight = toxicity.bag(text)
    assert ids.tolist() == sorted(want) and np.allclose(weight, [want[b] for b in ids.tolist()], atol=1e-6)
    # n-grams of one word: lengths 3 to 6 with both ends marked, and the word itself
    assert len(toxicity.subwords(["three"])[1]) == 5 + 4 + 3 + 2 + 1
    assert set(toxicity.subwords(["idiot"])[1]) & set(toxicity.subwords(["idiots"])[1])


def test_slices_change_nothing(monkeypatch):
    text = "alpha beta\tgamma delta " * 40 + "x" * 300
    whole = toxicity.bag(text)
    monkeypatch.setattr(toxicity, "SLICE_CHARS", 17)
    parts = toxicity.bag(text)
    assert whole[0].tolist() == parts[0].tolist() and np.allclose(whole[1], parts[1], atol=1e-6)


def labelled(n=600, seed=4):
    rng = random.Random(seed)
    bad = [f"idiot{e}" for e in ("", "s", "ic", "ically", "o", "a")]
    rows = []
    for i in range(n):
        w = [rng.choice(CLEAN) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_learns_and_catches_unseen_misspellings():
    rows = labelled()
    model = toxicity.fit_texts([t for _, t, _ in rows], [y for *_, y in rows])
    score = toxicity.Scorer(model).score
    assert score("the river runs over flat idiotzz stones near our old town") > 0.3  # no such word was seen
    assert score("you are an Idiot!") > 0.3
    assert score(" ".join(CLEAN)) < 0.3 and score("warm evenings") < 0.3 and score(None) == score("") == score(" ... ") < 0.3
    margins, offset = model.margins(), float(model.bias[1] - model.bias[0])
    for text in ("the old idiot walks", "near our town"):
        ids, weight = toxicity.bag(text)
        assert abs(score(text) - 1 / (1 + np.exp(-(offset + margins[ids] @ weight)))) < 1e-4
    again = toxicity.fit_texts([t for _, t, _ in rows], [y for *_, y in rows])
    assert (again.vectors == model.vectors).all()


def test_odd_rows_and_models(spark):
    rows = labelled(200)
    docs = spark.createDataFrame([*rows, (3, None, 0), (None, "idiot", 0), (900, "idiot " * 20_000, 0), (901, "", 0), (902, "idiot " * 20_000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([*[(i, y) for i, _, y in rows], (3, None), (None, 1), (900, 1), (900, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "score"]
    found = {r["doc_id"]: r["score"] for r in got.collect()}
    assert all(0 <= s <= 1 for s in found.values()) and found[900] == found[902] > 0.9
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}
    one = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert max(r["score"] for r in toxicity.score(docs, one).collect()) < 0.3


def test_held_out_labels(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    got = {r["doc_id"]: r for r in queries.op12_toxicity(spark, folder).collect()}
    assert len(got) == 10_000
    hit = {0: [], 1: []}
    for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IS NOT NULL").collect():
        held = zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert got[r["doc_id"]]["held_out"] == held
        if held:
            hit[r["toxic"]].append(got[r["doc_id"]]["predicted"])
    # 300 toxic texts to learn from; on 1,600 and more recall is 0.98 (README).
    assert np.mean(hit[1]) > 0.6 and np.mean(hit[0]) < 0.03
