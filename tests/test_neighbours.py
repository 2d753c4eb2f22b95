import numpy as np
import pandas as pd
import pytest

from lakeprofile.operators import neighbours as K


def brute_force(queries, train, k, metric, skip_self):
    result = {}
    for qid, q in queries:
        dist = []
        for tid, t, label in train:
            gap = np.abs(np.array(q) - np.array(t))
            d = float(np.sqrt((gap * gap).sum()) if metric == "euclidean" else gap.sum())
            if not (skip_self and tid == qid):
                dist.append((round(d, 9), tid, label))
        result[qid] = sorted(dist)[:k]
    return result


def points(n, copies, seed):
    """Clustered vectors, a third of them copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 4)) * 10
    rows = [(i, [float(x) for x in np.round(centres[i % 5] + rng.normal(size=4), 3)], int(i % 3)) for i in range(n)]
    return rows + [(n + i, [1.0, 1.0, 1.0, 1.0], 1) for i in range(copies)]


@pytest.mark.parametrize("metric", ["euclidean", "cityblock"])
@pytest.mark.parametrize("bound", [K.BROADCAST_VALUES, 0])
@pytest.mark.parametrize("mode", ["all", "others"])
def test_nearest_is_exact(spark, monkeypatch, metric, bound, mode):
    monkeypatch.setattr(K, "BLOCK_ROWS", 16)
    monkeypatch.setattr(K, "PIVOTS", 6)
    train = points(160, 80, 1)
    queries = [(i, v) for i, v, _ in points(160, 80, 1)[:60] + train[-5:]]
    q = spark.createDataFrame(queries, "qid long, features array<double>")
    t = spark.createDataFrame(train, "tid long, features array<double>, label int")
    found = K.nearest(q, t, 9, metric, mode=mode, broadcast_values=bound, visits_per_chunk=20)
    got = {}
    for r in found.collect():
        got.setdefault(r["qid"], []).append((round(r["dist"], 9), r["tid"], r["label"]))
    assert {i: sorted(v) for i, v in got.items()} == brute_force(queries, train, 9, metric, mode == "others")


@pytest.mark.parametrize("bound", [K.BROADCAST_VALUES, 0])
def test_held_out_rows_are_skipped(spark, monkeypatch, bound):
    monkeypatch.setattr(K, "BLOCK_ROWS", 16)
    monkeypatch.setattr(K, "PIVOTS", 6)
    rows = points(90, 45, 2)
    held = {s: {i for i, _, _ in rows if i % 4 == s} for s in range(3)}
    queries = [(i, s, v) for i, v, _ in rows for s in range(3) if i in held[s]]
    train = [(i, v, label, [s for s in range(3) if i in held[s]]) for i, v, label in rows]
    q = spark.createDataFrame(queries, "qid long, split int, features array<double>")
    t = spark.createDataFrame(train, "tid long, features array<double>, label int, held_out array<int>")
    got = {}
    for r in K.nearest(q, t, 9, mode="splits", broadcast_values=bound, visits_per_chunk=30).collect():
        got.setdefault((r["split"], r["qid"]), []).append((round(r["dist"], 9), r["tid"], r["label"]))
    expected = {}
    for s in range(3):
        rest = [row for row in rows if row[0] not in held[s]]
        mine = [(i, v) for i, v, _ in rows if i in held[s]]
        expected |= {(s, i): n for i, n in brute_force(mine, rest, 9, "euclidean", False).items()}
    assert {key: sorted(v) for key, v in got.items()} == expected


def test_fewer_training_rows_than_neighbours(spark):
    q = spark.createDataFrame([(0, [0.0])], "qid long, features array<double>")
    t = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b")], "tid long, features array<double>, label string")
    assert [r["tid"] for r in K.nearest(q, t, 9).orderBy("rank").collect()] == [1, 2]


def test_vote_weighs_by_inverse_distance_and_zero_distance_wins(spark):
    rows = [
        (0, 0, "a", 1.0), (0, 0, "b", 2.0), (0, 0, "b", 2.0), (0, 0, "b", 4.0),
        (1, 0, "a", 0.0), (1, 0, "b", 0.1), (1, 0, "b", 0.1),
        (2, 0, "b", 1.0), (2, 0, "a", 1.0),
    ]
    df = spark.createDataFrame(rows, "qid long, split int, label string, dist double")
    got = {r["qid"]: (r["prediction"], r["certainty"]) for r in K.vote(df).collect()}
    assert got[0] == ("b", pytest.approx(1.25 / 2.25))
    assert got[1] == ("a", 1.0)
    assert got[2] == ("a", 0.5)
    uniform = {r["qid"]: r["prediction"] for r in K.vote(df, "uniform").collect()}
    assert uniform == {0: "b", 1: "b", 2: "a"}


def test_training_rows_go_to_their_own_block_only(spark, monkeypatch):
    """Every pair that may matter meets once, and training rows are copied only in blocks with many visits."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 16)
    monkeypatch.setattr(K, "PIVOTS", 6)
    train = points(160, 0, 3)
    q = spark.createDataFrame([(i, 0, v) for i, v, _ in train], "qid long, split int, features array<double>")
    t = spark.createDataFrame(train, "tid long, features array<double>, label int")
    visits, placed = K._met(*K._in_blocks(q, t, 9, "euclidean"), 25)
    per_block = {}
    for r in visits.collect():
        per_block.setdefault((r.cell, r.block), []).append((r.qid, r.chunk))
    copies = {}
    for r in placed.collect():
        copies.setdefault((r.cell, r.block, r.tid), []).append(r.chunk)
    assert len({tid for _, _, tid in copies}) == len(copies) <= 160
    for (cell, block, _), chunks in copies.items():
        n = len(per_block[cell, block])
        assert sorted(chunks) == list(range(-(-n // 25)))
    for seen in per_block.values():
        assert len({q for q, _ in seen}) == len(seen)


@pytest.mark.parametrize("metric", ["euclidean", "cityblock"])
@pytest.mark.parametrize("scale", [1.0, 1e9, 1e120])
def test_tiles_hold_no_more_than_their_rows_and_stay_exact(monkeypatch, metric, scale):
    """The distances of one tile are held at a time, whatever the size of the training table; rounding loses nothing."""
    monkeypatch.setattr(K, "TILE_ROWS", 32)
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(400, 5)), 1) * scale
    train = pd.DataFrame({"tid": np.arange(400), "features": list(vectors), "label": np.arange(400) % 3})
    queries = pd.DataFrame({"qid": np.arange(50), "split": 0, "features": list(vectors[:50])})
    seen = []
    for name in ("_rough", "_direct"):
        real = getattr(K, name)
        monkeypatch.setattr(K, name, lambda q, t, *more, real=real: seen.append(len(t)) or real(q, t, *more))
    found = pd.concat(K._best(queries, K._Train.of(train, metric, "others"), 9, metric, "others"))
    assert max(seen) <= 32
    for i in range(50):
        gap = np.abs(vectors - vectors[i])
        dist = K._exact(np.repeat(vectors[i : i + 1], 400, axis=0), vectors, metric)
        assert np.allclose(dist, np.sqrt((gap * gap).sum(axis=1)) if metric == "euclidean" else gap.sum(axis=1))
        expected = sorted((d, t) for t, d in enumerate(dist) if t != i)[:9]
        mine = found[found["qid"] == i].sort_values("rank")
        assert list(zip(mine["dist"], mine["tid"])) == expected


def test_queries_are_stored_once_however_many_blocks_they_visit(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 16)
    monkeypatch.setattr(K, "PIVOTS", 6)
    train = points(160, 0, 3)
    q = spark.createDataFrame([(i, 0, v) for i, v, _ in train], "qid long, split int, features array<double>")
    t = spark.createDataFrame(train, "tid long, features array<double>, label int")
    visits, _ = K._in_blocks(q, t, 9, "euclidean")
    assert visits.count() == 160


def test_small_cells_share_a_block(monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 100)
    groups = K._groups({0: 40, 1: 300, 2: 40, 3: 20}, np.array([[0.0], [50.0], [1.0], [2.0]]))
    assert groups[0] == groups[2] == groups[3] != groups[1]
