import random

import numpy as np
import pytest

from prosegauge.llm import quality, toxicity, training
from prosegauge.llm.common import WordMemo, table
from prosegauge.llm.training import fold, platt

SF = "/root/testdata/sf0.01"


def texts_and_labels(n, seed):
    rng = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta the of and in".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(5, 200))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grobnik", "Grobna!!"])
        texts.append(" ".join(words).encode())
        y.append(int(bad))
    return texts, np.array(y)


def test_convolution_learns_words_and_long_texts():
    texts, y = texts_and_labels(1200, 1)
    model = toxicity.train(texts[:900], y[:900])
    memo = WordMemo(toxicity.word_code)
    scores = model.scores(texts[900:], memo)
    assert ((scores >= 0.5) == y[900:]).mean() > 0.95
    assert ((scores >= 0) & (scores <= 1)).all()
    long = b"alpha1 beta2 " * 60_000
    assert model.scores([long + b"grobnik", long], memo)[0] > 0.5 > model.scores([long], memo)[0]
    assert model.scores([None], memo)[0] == model.scores([b""], memo)[0] < 0.5


def test_pooling_does_not_depend_on_neighbours():
    texts, y = texts_and_labels(300, 2)
    model = toxicity.train(texts, y, epochs=2)
    memo = WordMemo(toxicity.word_code)
    together = model.scores([*texts, b"", None, b"one"], memo)
    alone = [model.scores([t], memo)[0] for t in [*texts, b"", None, b"one"]]
    assert np.allclose(together, alone, atol=1e-5)


def test_blocks_lose_no_window(monkeypatch):
    texts, y = texts_and_labels(200, 3)
    model = toxicity.train(texts, y, epochs=2)
    memo = WordMemo(toxicity.word_code)
    want = model.scores(texts, memo)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(model.scores(texts, memo), want, atol=1e-5)


@pytest.mark.parametrize("y", [[], [1] * 9, [0] * 9])
def test_one_class_scores_its_share(y):
    texts = [b"some text"] * len(y)
    up = (sum(y) + 1) / (len(y) + 2)
    q = quality.train(texts, np.array(y, dtype=int)).scores([b"", b"x"], WordMemo(quality.shape))
    assert np.allclose(q, up)
    t = toxicity.train(texts, np.array(y, dtype=int)).scores([b"", b"x"], WordMemo(toxicity.word_code))
    assert np.allclose(t, up if up != 0.5 else 0.5)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 500, 40)).astype(np.int32) for _ in range(300)]
    y = np.array([int(x.min() < 8) for x in rows])
    w, b = quality.dual_coordinate_descent(rows, y, np.ones(1 << quality.BITS), np.full(300, 100.0), 200)
    got = np.array([w[x].sum() / np.sqrt(len(x)) + b for x in rows])
    assert ((got > 0) == y).mean() > 0.97


def test_features_cover_blocks(monkeypatch):
    memo = WordMemo(quality.shape)
    text = ("Lorem IPSUM 12 dolor!! sit, " * 50).encode()
    want = quality.features(text, memo)
    monkeypatch.setattr(quality, "BLOCK", 13)
    assert (quality.features(text, memo) == want).all()
    assert len(quality.features(b"", memo)) == 0


def test_platt_orders():
    m = np.linspace(-3, 3, 200)
    a, b = platt(m, (m > 0.5).astype(int))
    assert a > 0 and abs(-b / a - 0.5) < 0.3


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_held_out_accuracy_and_edge_rows(spark, kind):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    if kind == "quality":
        model, score, mod, rest, label = quality.fit_quality(docs, labels), quality.score_quality, 3, 1, "quality"
    else:
        model, score, mod, rest, label = toxicity.fit_toxicity(docs, labels), toxicity.score_toxicity, 5, 0, "toxic"
    held = labels.where(fold("doc_id", mod) == rest).select("doc_id", label)
    got = score(docs.select("doc_id", "text"), model, out_col="s").join(held, "doc_id").toPandas()
    assert ((got.s >= 0.5) == got[label]).mean() > (0.97 if kind == "quality" else 0.85)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "a b " * 200_000, None)], "doc_id long, text string, s double")
    rows = score(odd, model, out_col="s").collect()
    assert len(rows) == 3 and all(0 <= r.s <= 1 for r in rows)
    assert score(odd.limit(0), model).count() == 0
    empty = labels.limit(0)
    assert (quality.fit_quality if kind == "quality" else toxicity.fit_toxicity)(docs, empty) is not None


def test_long_texts_do_not_shrink_the_sample(spark):
    texts, y = texts_and_labels(200, 4)
    docs = [(i, t.decode()) for i, t in enumerate(texts)]
    long = " ".join(f"begin{i} " + "alpha1 beta2 " * 4000 + f"end{i}" for i in range(6))
    docs[:60] = [(i, long) for i in range(60)]  # 312 kB each, of 500 kB together
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    got, of = training.labelled_sample(rows, labels, "quality", 3, 1, 3000, 500_000)
    whole, same = training.labelled_sample(rows, labels, "quality", 3, 1, 3000, 1 << 40)
    assert (of == same).all() and len(got) == len(whole) > 100 and sum(map(len, got)) <= 500_000
    assert all(a == b for a, b in zip(got, whole, strict=True) if len(b) < 10_000)
    cut = [a for a, b in zip(got, whole, strict=True) if len(b) >= 10_000]
    assert cut and all(len(a) > 4000 and a.startswith(b"begin0") and a.endswith(b"end5") for a in cut)
    assert {w for a in cut for w in a.split()} <= set(long.encode().split())


def test_shares_and_excerpts():
    assert training.fair_share(np.array([5, 100, 1]), 20) == 14 and training.fair_share(np.array([5, 6]), 20) == 6
    assert training.fair_share(np.array([], dtype=int), 20) == 0 and training.fair_share(np.array([9, 9, 9]), 20) == 6
    for n in (0, 5, 16, 40, 400):
        for text in (b"x" * 1000, b"ab cd " * 200):
            assert len(training.excerpt(text, n)) <= n


def test_too_few_of_a_class_raise(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS quality", "int(doc_id % 3 = 0) AS toxic")
    for fit in (quality.fit_quality, toxicity.fit_toxicity):
        with pytest.raises(ValueError, match="at least 5 of each"):
            fit(docs, labels, sample_rows=7)
        assert fit(docs.limit(0), labels) is not None
