import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lakeprofile.llm import whitening as W


def poly(roots):
    out = [1]
    for r in roots:
        out = [(out[i - 1] if i else 0) - r * (out[i] if i < len(out) else 0) for i in range(len(out) + 1)]
    return out


def test_characteristic_polynomial_is_exact(spark):
    rng = random.Random(1)
    for size, most in ((1, 5), (2, 9), (5, 10**12), (9, 3)):
        rows = [[rng.randint(-most, most) for _ in range(size)] for _ in range(size + 2)]
        rows[-1] = rows[0]
        matrix = [[sum(r[i] * r[j] for r in rows) for j in range(size)] for i in range(size)]
        found = W.characteristic_polynomial(spark, matrix)
        assert found[-1] == 1 and found[-2] == -sum(matrix[i][i] for i in range(size))
        # Cayley and Hamilton: the matrix is a root of its own polynomial, exactly.
        m, total = np.array(matrix, dtype=object), np.zeros((size, size), dtype=object)
        for c in reversed(found):
            total = total.dot(m) + c * np.eye(size, dtype=int).astype(object)
        assert not total.any()
    assert W.characteristic_polynomial(spark, [[0, 0], [0, 0]]) == [0, 0, 1]


def test_roots_with_multiplicity(spark):
    roots = [1_000, 1_000, 999, 40, 40, 40, 7, 0, 0]
    found = W.largest_roots(spark, poly(roots), sum(roots), 5)
    assert [(float(r.value), r.count) for r in found] == [(1000.0, 2), (999.0, 1), (40.0, 3)]
    assert W.roots_above(poly(roots), 40, 0) == 3 and W.roots_above(poly(roots), 79, 1) == 6
    assert W.largest_roots(spark, poly([0, 0]), 0, 5) == []
    golden = W.largest_roots(spark, [1, -3, 1], 3, 2)  # (3 +- sqrt 5) / 2
    for root, value in zip(golden, ((3 + 5**0.5) / 2, (3 - 5**0.5) / 2)):
        assert math.isclose(float(root.value), value, rel_tol=1e-15)
        assert abs(root.value**2 - 3 * root.value + 1) < Fraction(1, 1 << 140)


def brute(vectors, components=16):
    usable = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in usable], dtype=np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / len(fit)
    values, axes = np.linalg.eigh(cov)
    keep = [i for i in np.argsort(-values) if values[i] > 1e-9][:components]
    white = (x - fit.mean(axis=0)) @ axes[:, keep] / np.sqrt(values[keep])
    y = len(fit) * x.astype(object) - fit.astype(object).sum(axis=0)
    return len(fit), (y * y).sum(axis=1), white, values[keep] / np.trace(cov), x


def compared(spark, vectors, dimension, components=16):
    rows = [(i, v, 1.0, "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened double, x string")
    out = W.whiten(df, components=components)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    floats = [None if v is None else [None if c is None else float(np.float32(c)) for c in v] for v in vectors]
    floats = [v if v and len(v) == dimension else None for v in floats]
    n, deviation, white, explained, _ = brute(floats, components)
    ids = [i for i, v in enumerate(floats) if v and all(c is not None and math.isfinite(c) for c in v)]
    assert sorted((r.vec_id, r.component) for r in got) == [(i, k + 1) for i in ids for k in range(len(explained))]
    table = np.zeros_like(white)
    for r in got:
        at = ids.index(r.vec_id)
        assert r.n == n and int(r.deviation) == deviation[at] and r.identity_error < 1e-9
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        table[at, r.component - 1] = r.whitened
    signs = np.sign((table * white).sum(axis=0))
    assert np.allclose(table, white * signs, atol=1e-8)
    assert len({r.identity_error for r in got}) == 1


def test_equals_floating_point(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(80, 6)) * [5, 3, 2, 1, 0.5, 0.2] + 4).tolist()
    vectors += [vectors[0]] * 40  # repeated rows count once in the fit
    vectors += [None, [None] * 6, [float("nan")] * 6, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0], [], [1.0, 2.0], [1e38] * 6]
    known = [v if v is None or len(v) != 6 or None in v or abs(v[0]) < 1e30 else None for v in vectors]
    rows = [(i, v) for i, v in enumerate(vectors)]
    assert W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 120 * 6
    compared(spark, known, 6)
    compared(spark, known, 6, components=2)


def test_components_without_spread_are_left_out(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-50, 50, size=(30, 2)) / 64
    vectors = np.hstack([base, base[:, :1], np.ones((30, 1))]).tolist()  # rank 2 of 4
    compared(spark, vectors, 4)


def test_equal_eigenvalues(spark):
    vectors = [[a / 64, b / 64, c / 64] for a in (-9, 9) for b in (-9, 9) for c in (-9, 9)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = W.whiten(df).collect()
    z = np.zeros((8, 3))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
        assert math.isclose(r.explained, 1 / 3, rel_tol=1e-12)
    assert np.allclose(z.T @ z / 8, np.eye(3), atol=1e-12)


def test_long_numbers_stay_exact(spark):
    vectors = [[2.0**50 + i, -(2.0**49) * (i % 3), float(i)] for i in range(9)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    for r in W.whiten(df).collect():
        assert int(r.deviation) == sum((9 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums)) and r.identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_fit(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert W.whiten(df).collect() == []
