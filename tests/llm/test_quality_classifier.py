import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeprofile.llm import catalog
from lakeprofile.llm import quality_classifier as Q


def named(text):
    return dict(zip(Q.NAMES, Q.statistics(text).tolist()))


def test_statistics():
    got = named("Äb 12 ab ab##\nab.\n\n")
    assert got["characters"] == math.log1p(19) and got["words"] == math.log1p(5) and got["lines"] == math.log1p(4)
    assert got["digits"] == 2 / 19 and got["symbols"] == 2 / 19 and got["blanks"] == pytest.approx(6 / 19)
    assert got["letterless_words"] == pytest.approx(0.2) and got["symbol_endings"] == 1 / 5 and got["blank_lines"] == 0.5
    assert got["closed_lines"] == 0.5 and got["distinct_words"] == 1.0 and got["echoes"] == 0
    assert named("a a a a")["echoes"] == 3 / 4 and named("a a a a")["top_word"] == 1.0
    assert named("x\nx\ny")["repeated_lines"] == pytest.approx(1 / 3)
    for blank in (None, "", " \n\t ", "\n"):
        assert not Q.statistics(blank).any()
    assert np.isfinite(Q.statistics("x" * 3_000_000 + " y")).all() and np.isfinite(Q.statistics("日本   x")).all()


def brute_isotonic(values, weights):
    """Least squares under rising values, as the min of max means."""
    n = len(values)
    mean = lambda a, b: sum(v * w for v, w in zip(values[a:b], weights[a:b])) / sum(weights[a:b])
    return [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]


def test_pooling_is_isotonic_regression():
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randint(1, 12)
        weights = [rng.randint(1, 4) for _ in range(n)]
        good = [rng.randint(0, w) for w in weights]
        want = brute_isotonic([g / w for g, w in zip(good, weights)], weights)
        at = np.arange(n, dtype=float)
        scores, values = Q.pooled(at, np.array(good, dtype=float), np.array(weights, dtype=float))
        assert np.all(np.diff(scores) > 0) and sorted(set(np.round(want, 9))) == np.round(values, 9).tolist()


def table(spark, seed=1, rows=400):
    """Good texts, and bad ones of two kinds; every fifth document has no label."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(rows):
        n = rng.randint(20, 120)
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(n)]
        kind = i % 4
        text = " ".join(w + rng.choice(["###", "$$$"]) for w in words) if kind == 0 else " ".join(words[:1] * n) if kind == 1 else " ".join(words) + "."
        docs.append((i, text))
        if i % 5:
            labels.append((i, int(kind > 1)))
    return docs, labels


def test_matches_a_direct_fit(spark):
    """The distributed sums give the ridge solution that numpy finds in one piece, and order good before bad."""
    docs, labels = table(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    stats = Q.stored(df.select("doc_id", Q.statistics_column()("text").alias("stats")), "statistics")
    model = Q.learn(stats, known)
    of = dict(docs)
    x = np.array([Q.statistics(of[i]) for i, _ in labels])
    y = np.array([q for _, q in labels], dtype=float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.spread, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1))
    z = model.fourier(x)
    ridge = Q.RIDGE * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + ridge, z.T @ y), atol=1e-6)
    # Products of the features come near the Gaussian kernel.
    at = np.clip((x - model.mean) / model.spread, -Q.CLIP, Q.CLIP)
    kernel = np.exp(-((at[:50, None] - at[None, :50]) ** 2).sum(axis=2) / (2 * len(Q.NAMES)))
    assert np.abs(z[:50, :-1] @ z[:50, :-1].T - kernel).mean() < 0.08
    got = {r.doc_id: r.score for r in Q.score(stats, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i, _ in docs if i % 4 > 1) > 0.5 > max(got[i] for i, _ in docs if i % 4 < 2)


def test_cases_without_rule(spark):
    docs, labels = table(spark)
    docs += [(1000, None), (1001, ""), (None, "x y"), (5, docs[5][1]), (5, docs[5][1]), (1002, "w " * 300_000)]
    labels += [(5, 0), (None, 1), (7, None), (2000, 1)]
    rows = [(d, t, 9, "z") for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, stats int, id string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = Q.classify(df, known, sample=300).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert {r.score for r in Q.classify(df, known.limit(0)).collect()} == {0.5}
    assert Q.classify(df.limit(0), known).collect() == []
    ones = Q.classify(df, known.where("quality = 1")).collect()
    assert min(r.score for r in ones) > 0.9


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = catalog.QUERIES["op12_quality_classifier"](spark, folder)
    truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    judged = got.where("held_out").join(truth, "doc_id")
    hits = judged.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert hits[1] > 500 and hits[0] > 0.97
