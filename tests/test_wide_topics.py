"""The topic model whose words are rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeprofile.operators.text import tokenize
from lakeprofile.plans import wide_topics as W
from lakeprofile.plans.topics import infer_topics, train_topics


def texts(n=40):
    rng = np.random.default_rng(5)
    themes = [[f"{c}{chr(97 + i)}{c}word" for i in range(12)] for c in ("ab", "xy")]
    rows = [(i, " ".join([*rng.choice(themes[i % 2], 30), f"only{chr(97 + i % 26)}{chr(97 + i // 26)}once"])) for i in range(n)]
    return [*rows, (n, ""), (n + 1, None), (n + 2, "1 2 3")]


def test_digamma():
    x = np.array([0.01, 0.5, 1.0, 2.0, 50.0])
    expected = [-100.56088545786868, -1.9635100260214235, -0.5772156649015329, 0.4227843350984671, 3.901989673427892]
    assert np.allclose(W.digamma(x), expected, rtol=1e-9)


@pytest.mark.parametrize("frequent", [10, 1000])
def test_more_words_than_allowed_are_fitted_all_the_same(spark, monkeypatch, frequent):
    """A corpus beyond the bound of MLlib used to be refused; every text with words has topics."""
    monkeypatch.setattr(W.train_wide, "__defaults__", (frequent,))
    docs = spark.createDataFrame(texts(), "doc_id int, text string")
    model = train_topics(docs, k=2, largest=20, iterations=10)
    assert len(model.frequent) + model.rare.count() == 24 + 40
    found = {r["doc_id"]: r for r in infer_topics(docs, model).collect()}
    assert len(found) == 43
    for i in range(40):
        assert sum(t["weight"] for t in found[i]["topics"]) == pytest.approx(1) and len(set(found[i]["tags"])) == 10
    assert all(found[i]["topics"] is None and found[i]["tags"] is None for i in (40, 41, 42))


def test_where_words_lie_does_not_matter(spark):
    rows = [(0, "a", 3), (0, "b", 1), (1, "b", 2), (1, "c", 2), (2, "d", 4)]
    bag = spark.createDataFrame(rows, "path int, term string, n long")
    found = []
    for frequent in (1, 4):
        model = W.train_wide(bag, "path", 2, 7, 4, frequent)
        found.append({r["path"]: [t["weight"] for t in r["topics"]] for r in model.topics_of(bag, "path").collect()})
    assert found[0].keys() == found[1].keys() == {0, 1, 2}
    for i in found[0]:
        assert found[0][i] == pytest.approx(found[1][i], abs=1e-6)


def test_saved_models_are_read_back(spark, tmp_path):
    bag = spark.createDataFrame([(0, "a", 3), (0, "b", 1), (1, "c", 2)], "path int, term string, n long")
    model = W.train_wide(bag, "path", 2, 7, 2, 1)
    model.save(str(tmp_path / "model"))
    loaded = W.WideTopicModel.load(spark, str(tmp_path / "model"))
    assert sorted(map(str, loaded.topics_of(bag, "path").collect())) == sorted(map(str, model.topics_of(bag, "path").collect()))


def test_steps_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(i, w, int(rng.integers(1, 5))) for i in range(12) for w in rng.choice(list("abcdefghij"), 4, replace=False)]
    bag = spark.createDataFrame([(i, str(w), n) for i, w, n in rows], "path int, term string, n long")

    def weights(model):
        return dict(zip(model.frequent, model.weights)) | {r["term"]: np.array(r["weights"]) for r in model.rare.collect()}

    plain, k = weights(W.train_wide(bag, "path", 3, 7, 0, 4)), 3
    for step in range(1, 4):
        totals, stat = sum(plain.values()), {w: np.zeros(k) for w in plain}
        for i in range(12):
            mine = [(w, n) for j, w, n in rows if j == i]
            beta = np.array([np.exp(W.digamma(plain[w]) - W.digamma(totals)) for w, _ in mine])
            for (w, _), s in zip(mine, W._fit_texts(beta, np.array([float(n) for _, n in mine]), np.zeros(1, int), 1 / k)[1]):
                stat[w] += s
        rho = (1 + step) ** -0.51
        plain = {w: (1 - rho) * plain[w] + rho * (stat[w] + 1 / k) for w in plain}
    found = weights(W.train_wide(bag, "path", 3, 7, 3, 4))
    assert found.keys() == plain.keys()
    for w in plain:
        assert found[w] == pytest.approx(plain[w], rel=1e-3)  # texts stop at a change of a thousandth


def weights_of(model):
    return dict(zip(model.frequent, model.weights)) | {r["term"]: np.array(r["weights"]) for r in model.rare.collect()}


def test_a_text_is_fitted_as_one_text(spark):
    """Every occurrence of a word used to be numbered as a text of its own."""
    docs = spark.createDataFrame(texts(), "doc_id int, text string")
    bag = tokenize(docs).select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    found, expected = weights_of(train_topics(docs, k=2, largest=20, iterations=3)), weights_of(W.train_wide(bag, "doc_id", 2, 7, 3))
    assert found.keys() == expected.keys()
    for word, weights in expected.items():
        assert found[word] == pytest.approx(weights, rel=1e-9)


def test_chunks_and_blocks_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame([*texts(), (50, "abaword " * 300)], "doc_id int, text string").coalesce(2)
    found = []
    for chunk_words, numbers in ((1 << 21, 1 << 21), (100, 16)):
        monkeypatch.setattr(W, "CHUNK_WORDS", chunk_words)
        monkeypatch.setattr(W, "BLOCK_NUMBERS", numbers)
        model = train_topics(docs, k=2, largest=20, iterations=2)
        topics = {r["doc_id"]: [t["weight"] for t in r["topics"] or []] for r in infer_topics(docs, model).collect()}
        found.append((weights_of(model), topics))
    (weights, topics), (others, other_topics) = found
    assert weights.keys() == others.keys() and topics.keys() == other_topics.keys()
    for word in weights:
        assert others[word] == pytest.approx(weights[word], rel=1e-9)
    for i in topics:
        assert other_topics[i] == pytest.approx(topics[i], rel=1e-9)


def test_texts_are_fitted_as_by_plain_loops():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 7, 1, 40, 7])
    beta, ids, n = rng.random((30, 4)) + 0.01, rng.integers(0, 30, sizes.sum()), rng.integers(1, 300, sizes.sum()).astype("u2")
    gamma, share = W._fit(beta, ids, n, sizes, 0.25)
    for i, start in enumerate(np.cumsum(sizes) - sizes):
        words, counts = beta[ids[start : start + sizes[i]]], n[start : start + sizes[i]].astype(float)
        plain = np.full(4, 0.25 + counts.sum() / 4)
        for _ in range(W.INNER_STEPS if sizes[i] else 0):
            theta, before = np.exp(W.digamma(plain)), plain
            plain = 0.25 + theta * ((counts / (words @ theta))[:, None] * words).sum(axis=0)
            if np.abs(plain - before).mean() < W.INNER_CHANGE:
                break
        assert gamma[i] == pytest.approx(plain, rel=1e-9)
        assert share[start : start + sizes[i]] == pytest.approx(counts / (words @ np.exp(W.digamma(plain))), rel=1e-9)
