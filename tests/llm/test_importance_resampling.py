import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lakeprofile.llm import importance_resampling as R


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def runs(text, orders):
    own = words(text)
    return [zlib.crc32(" ".join(own[i : i + n]).encode()) for n in orders for i in range(len(own) - n + 1)]


def brute(docs, target, orders=(1,), buckets=50, percent=40, least=3, seed=7):
    own, wanted = [0] * buckets, [0] * buckets
    for _, text in docs:
        for h in runs(text, orders):
            own[h % buckets] += 1
    for text in target:
        for h in runs(text, orders):
            wanted[h % buckets] += 1
    total, goal = sum(own), sum(wanted)
    gain = [
        math.floor(1000 * math.log((t + 1) * (total + buckets) / ((s + 1) * (goal + buckets)))) for s, t in zip(own, wanted)
    ]
    rows = []
    for doc, text in docs:
        found = [gain[h % buckets] for h in runs(text, orders)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(words(text)), len(found), weight, score, None])
    fit = [r for r in rows if r[1] >= least]
    fit.sort(key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for place, row in enumerate(fit[: len(fit) * percent // 100]):
        row[5] = place + 1
    return rows


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x or 0) for x in r])


@pytest.mark.parametrize("orders", [(1,), (1, 2, 3)])
def test_equals_brute_force(spark, orders, monkeypatch):
    monkeypatch.setattr(R, "SPLIT_BYTES", 30)  # texts in many stretches
    rng = random.Random(len(orders))
    some = "The cat É sat-on ß x1 日本 Mat a a".split(" ")
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(some) for _ in range(n))
    docs = [(i, text(rng.randint(0, 90))) for i in range(60)] + [(60, ""), (61, None), (62, "...")]
    docs += [(3, docs[3][1])] * 20 + [(None, text(30))] * 20 + [(7, text(40)), (7, text(50))]
    target = [text(20), None, "", "cat cat cat"]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, rank string")
    want = spark.createDataFrame([(t,) for t in target], "text string")
    options = {"orders": orders, "buckets": 50, "percent": 40, "least_words": 3, "seed": 7}
    out = R.resample(df, want, **options)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    expected = brute(docs, target, orders)
    assert ordered(out.collect()) == ordered(expected)
    kept = R.draw(df, want, **options)
    assert kept.columns == df.columns
    chosen = {r[0] for r in expected if r[5]}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d in chosen)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.weight, r["rank"]) for r in R.resample(df, df.limit(0), percent=100).collect()} == {
        (1, R.gains(np.bincount([zlib.crc32(b"a") % 10000] * 30, minlength=10000), np.zeros(10000))[zlib.crc32(b"a") % 10000], 1),
        (2, 0, None),
    }
    assert R.resample(df.limit(0), df).collect() == []
    assert R.resample(df, df, percent=10).where("rank is not null").count() == 0


def test_bisection(spark):
    rng = random.Random(5)
    for values in ([5], [3] * 50, [rng.randint(-(2**62), 2**62) for _ in range(40)], [rng.randint(0, 9) for _ in range(60)]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        for k in {1, len(values), (len(values) + 1) // 2}:
            assert R.kth_largest(df, R.F.col("v"), k) == sorted(values, reverse=True)[k - 1]
