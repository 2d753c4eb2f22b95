"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.llm.common import stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
ROOT_BITS = 160  # an eigenvalue is known to so many bits below the trace
WORK_BITS = 448  # fraction bits of the elimination behind a component
PRIMES_PER_TASK = 16
BLOCK_ROWS = 4_096  # rows that a task multiplies at once
LARGEST = float(1 << 62)

_LIMB = 48
_LIMBS = 4


# ---- integer vectors


def is_usable(vector: Column) -> Column:
    """Not null, and every entry is there, finite and small enough for its integer to be a long."""
    entry = lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < LARGEST)  # noqa: E731, nan is above all numbers
    return F.coalesce(F.forall(vector, entry), F.lit(False))


def integers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of every entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + OFFSET)


def _matrices(column: pa.Array) -> Iterator[np.ndarray]:
    """Equally long lists as blocks of rows of int64."""
    for at in range(0, len(column), BLOCK_ROWS):
        part = column.slice(at, BLOCK_ROWS)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        yield flat.reshape(len(part), -1)


# ---- partition sums


def _limbs(value: int) -> list[int]:
    """A whole number as limbs, lowest first; the last one carries the sign."""
    out = []
    for _ in range(_LIMBS - 1):
        out.append(value & ((1 << _LIMB) - 1))
        value >>= _LIMB
    return [*out, value]


def products(x: np.ndarray) -> np.ndarray:
    """x' x, exactly, in the cheapest numbers that hold it."""
    most = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    bound = most * most * len(x)
    if bound < 1 << 53:
        wide = x.astype(np.float64)
        return (wide.T @ wide).astype(np.int64)
    wide = x if bound < 1 << 62 else x.astype(object)
    return wide.T.dot(wide)


def moments(spark: SparkSession, vectors: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums, and sums of products of (x - offset), exact. A task hands on one row per pair of dimensions."""
    cells = [(i, j) for i in range(dimension) for j in range(i, dimension)]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimension
        held = np.zeros((dimension, dimension), dtype=object)
        for batch in batches:
            for block in _matrices(batch.column(0)):
                x = block - OFFSET
                n += len(x)
                held = held + products(x)
                part = x.sum(axis=0) if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object).sum(axis=0)
                sums = [a + int(b) for a, b in zip(sums, part)]
        if not n:
            return
        rows = [(-2, 0, n)] + [(-1, i, s) for i, s in enumerate(sums)] + [(i, j, int(held[i, j])) for i, j in cells]
        columns = {"i": [r[0] for r in rows], "j": [r[1] for r in rows]}
        for k, limb in enumerate(zip(*(_limbs(r[2]) for r in rows))):
            columns[f"l{k}"] = pa.array(limb, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()) if k < 2 else c for k, c in enumerate(columns.values())], names=list(columns)
        )

    names = [f"l{k}" for k in range(_LIMBS)]
    added = vectors.mapInArrow(add, "i int, j int, " + ", ".join(f"{n} bigint" for n in names))
    totals = added.groupBy("i", "j").agg(*[F.sum(F.col(n).cast("decimal(28,0)")).alias(n) for n in names])
    n, sums, scatter = 0, [0] * dimension, [[0] * dimension for _ in range(dimension)]
    for row in totals.collect():  # as many rows as the matrix has entries
        value = sum(int(row[name]) << (_LIMB * k) for k, name in enumerate(names))
        if row["i"] == -2:
            n = value
        elif row["i"] == -1:
            sums[row["j"]] = value
        else:
            scatter[row["i"]][row["j"]] = scatter[row["j"]][row["i"]] = value
    return n, sums, scatter


# ---- characteristic polynomial


def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The largest primes below a bound, largest first."""
    found, size = [], 1 << 16
    small = np.ones(int(below**0.5) + 1, dtype=bool)
    small[:2] = False
    for i in range(2, int(len(small) ** 0.5) + 1):
        if small[i]:
            small[i * i :: i] = False
    divisors = np.flatnonzero(small)
    top = below
    while len(found) < count:
        low = top - size
        sieve = np.ones(size, dtype=bool)
        for d in divisors.tolist():
            sieve[-low % d :: d] = False
        found += (low + np.flatnonzero(sieve)[::-1]).tolist()
        top = low
    return found[:count]


def residue_polynomials(matrix: list[list[int]], moduli: list[int]) -> np.ndarray:
    """Coefficients (lowest first) of det(t - matrix) modulo each prime, all primes side by side.

    Each matrix is brought to Hessenberg form by similarity, pivots chosen per prime; the polynomials of its leading
    blocks then follow from one another.
    """
    size, p = len(matrix), np.array(moduli, dtype=np.int64)
    h = np.array([[[v % m for v in row] for row in matrix] for m in moduli], dtype=np.int64)
    each, wide = np.arange(len(p)), p[:, None]
    for k in range(size - 2):
        column = h[:, k + 1 :, k] != 0
        pivot = k + 1 + np.argmax(column, axis=1)  # where all are zero the row swaps with itself and nothing is cleared
        for axis in (1, 2):
            rows = h if axis == 1 else h.transpose(0, 2, 1)
            here = rows[each, pivot].copy()
            rows[each, pivot] = rows[:, k + 1]
            rows[:, k + 1] = here
        inverse = np.array([pow(int(v), -1, m) if v else 0 for v, m in zip(h[:, k + 1, k], moduli)], dtype=np.int64)
        factors = h[:, k + 2 :, k] * inverse[:, None] % wide
        h[:, k + 2 :] = (h[:, k + 2 :] - factors[:, :, None] * h[:, None, k + 1] % p[:, None, None]) % p[:, None, None]
        for at in range(factors.shape[1]):
            h[:, :, k + 1] = (h[:, :, k + 1] + factors[:, at, None] * h[:, :, k + 2 + at]) % wide
    blocks = [np.zeros((len(p), size + 1), dtype=np.int64)]
    blocks[0][:, 0] = 1
    for k in range(size):
        last = blocks[-1]
        new = np.roll(last, 1, axis=1)
        new = (new - h[:, k, k, None] * last) % wide
        below = np.ones(len(p), dtype=np.int64)
        for i in range(k - 1, -1, -1):
            below = below * h[:, i + 1, i] % p
            new = (new - (below * h[:, i, k] % p)[:, None] * blocks[i]) % wide
        blocks.append(new)
    return blocks[-1]


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of det(t - matrix) of a positive semidefinite matrix is larger."""
    size = len(matrix)
    trace = sum(matrix[i][i] for i in range(size))
    return max((math.comb(size, k) * (trace**k) // size**k + 1 for k in range(size + 1)), default=1)


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t - matrix), lowest first, for a positive semidefinite matrix of whole numbers.

    Tasks reduce the matrix modulo disjoint sets of primes; the residues are put together by Chinese remainders.
    """
    bits = (2 * coefficient_bound(matrix) + 1).bit_length()
    moduli = primes(bits // 30 + 1)
    tasks = -(-len(moduli) // PRIMES_PER_TASK)

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                mine = moduli[task::tasks]
                rows = residue_polynomials(matrix, mine)
                yield pa.RecordBatch.from_pydict({"p": pa.array(mine, pa.int64()), "c": pa.array(rows.tolist(), pa.list_(pa.int64()))})

    found = spark.range(0, tasks, 1, tasks).mapInArrow(reduce, "p bigint, c array<bigint>").collect()
    values, modulus = [0] * (len(matrix) + 1), 1
    for row in sorted(found, key=lambda r: -r["p"]):
        p = row["p"]
        step = pow(modulus, -1, p)
        values = [v + modulus * ((c - v) * step % p) for v, c in zip(values, row["c"])]
        modulus *= p
    return [v - modulus if v > modulus // 2 else v for v in values]


# ---- roots


def roots_above(polynomial: list[int], numerator: int, bits: int) -> int:
    """Roots above numerator / 2^bits, with multiplicity, of a polynomial all of whose roots are real.

    The polynomial is moved there; with real roots only, the sign changes of its coefficients count the positive ones.
    """
    degree = len(polynomial) - 1
    moved = [c << (bits * (degree - k)) for k, c in enumerate(polynomial)]
    for i in range(degree):
        for k in range(degree - 1, i - 1, -1):
            moved[k] += numerator * moved[k + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(polynomial: list[int], numerator: int, bits: int) -> int:
    value, shift = 0, 0
    for c in reversed(polynomial):
        value = value * numerator + (c << shift)
        shift += bits
    return (value > 0) - (value < 0)


def root_interval(polynomial: list[int], k: int, trace: int, bits: int = ROOT_BITS) -> tuple[int, int]:
    """(low, fraction bits): the k-th largest root lies in (low, low + 1] / 2^fraction bits.

    Counts of roots halve the interval until one root is left in it, then signs of the polynomial do. Roots that
    stay together down to the last bit are equal, or as good as equal.
    """
    fraction = max(bits - trace.bit_length(), 0)
    low, high = -1, trace << fraction  # the trace bounds the largest root
    above_low, above_high = len(polynomial) - 1, 0
    while high - low > 1 and above_low - above_high > 1:
        middle = (low + high) >> 1
        above = roots_above(polynomial, middle, fraction)
        if above >= k:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    if high - low > 1:  # one root in (low, high], so the sign changes there and nowhere else
        beyond = 1 if above_high % 2 == 0 else -1  # sign between this root and the next larger one
        while high - low > 1:
            middle = (low + high) >> 1
            if _sign(polynomial, middle, fraction) == -beyond:
                low = middle
            else:
                high = middle
    return low, fraction


class Root(NamedTuple):
    """A root (low + 1/2) / 2^bits and how often it occurs."""

    low: int
    bits: int
    count: int

    @property
    def value(self) -> Fraction:
        return Fraction(2 * self.low + 1, 1 << (self.bits + 1))


def largest_roots(spark: SparkSession, polynomial: list[int], trace: int, wanted: int) -> list[Root]:
    """The largest roots above zero, falling, ``wanted`` in all counting multiplicity. One task per root finds it."""
    zeros = next((i for i, c in enumerate(polynomial) if c), len(polynomial) - 1)
    proper = polynomial[zeros:]  # without the roots that are exactly zero
    wanted = min(wanted, len(proper) - 1)
    if wanted <= 0:
        return []

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, bits = root_interval(proper, k, trace)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "low": [str(low)], "bits": pa.array([bits], pa.int64())})

    located = spark.range(1, wanted + 1, 1, wanted).mapInArrow(locate, "k bigint, low string, bits bigint").collect()
    found: list[Root] = []
    for row in sorted(located, key=lambda r: r["k"]):
        low = int(row["low"])
        if found and found[-1].low - low <= 1:
            found[-1] = found[-1]._replace(count=found[-1].count + 1)
        else:
            found.append(Root(low, row["bits"], 1))
    # The last cluster may go on below the wanted roots; its whole space is needed for a part of it.
    last = found[-1]
    rest = roots_above(proper, last.low, last.bits) if last.low >= 0 else len(proper) - 1
    return [*found[:-1], last._replace(count=max(rest - wanted + last.count, last.count))]


# ---- components


def null_space(matrix: list[list[int]], root: Root, bits: int = WORK_BITS) -> np.ndarray:
    """Orthonormal eigenvectors of a root, one row each, by inverse iteration in fixed-point numbers of many bits."""
    size = len(matrix)
    one = 1 << bits
    shift = int(root.value * one)
    scale = max(sum(matrix[i][i] for i in range(size)), 1)
    # Scaled by the trace, so that entries are at most one.
    a = np.array([[((v << bits) - (shift if i == j else 0)) // scale for j, v in enumerate(row)] for i, row in enumerate(matrix)], dtype=object)
    order, lower = np.arange(size), np.zeros((size, size), dtype=object)
    for k in range(size):
        pivot = k + max(range(size - k), key=lambda i: abs(a[k + i, k]))
        for table in (a, lower):
            table[[k, pivot]] = table[[pivot, k]]
        order[[k, pivot]] = order[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1  # the least number there is: the vectors sought grow along it
        if k + 1 < size:
            factors = (a[k + 1 :, k] << bits) // a[k, k]
            lower[k + 1 :, k] = factors
            a[k + 1 :] -= (factors[:, None] * a[None, k]) >> bits

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(size):
            x[k] -= int((lower[k, :k] * x[:k]).sum()) >> bits if k else 0
        for k in range(size - 1, -1, -1):
            rest = x[k] - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> bits if k + 1 < size else 0)
            x[k] = (rest << bits) // a[k, k]
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        length = math.isqrt(int((x * x).sum()))
        return np.array([(v << bits) // max(length, 1) for v in x], dtype=object)

    random = np.random.default_rng(size)
    found: list[np.ndarray] = []
    for _ in range(root.count):
        x = np.array([int(v) << (bits - 20) for v in random.integers(-(1 << 20), 1 << 20, size)], dtype=object)
        for _ in range(3):
            x = unit(solved(x))
            for _ in range(2):
                for other in found:
                    x = x - ((other * (int((x * other).sum()) >> bits)) >> bits)
                x = unit(x)
        found.append(x)
    return np.array([[float(Fraction(int(v), one)) for v in x] for x in found])


class Whitening(NamedTuple):
    """What the fit list teaches: projections are y @ vectors.T / roots with y = n x - sums."""

    n: int
    sums: list[int]  # of x, per dimension
    vectors: np.ndarray  # one component a row, by falling eigenvalue
    roots: np.ndarray  # square roots of the eigenvalues of the scatter matrix n^2 V
    explained: np.ndarray


def fit(spark: SparkSession, vectors: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening:
    """Components of stored distinct integer vectors (one column ``x``). Equal eigenvalues share any basis of their space.

    Components with an eigenvalue of exactly zero have no whitened form and are left out.
    """
    n, shifted, raw = moments(spark, vectors, dimension)
    # n^2 times the covariance; the same for any offset.
    scatter = [[n * raw[i][j] - shifted[i] * shifted[j] for j in range(dimension)] for i in range(dimension)]
    trace = sum(scatter[i][i] for i in range(dimension))
    sums = [s + n * OFFSET for s in shifted]
    found = largest_roots(spark, characteristic_polynomial(spark, scatter), trace, components) if trace else []
    if not found:
        return Whitening(n, sums, np.zeros((0, dimension)), np.zeros(0), np.zeros(0))

    def span(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                rows = null_space(scatter, found[at]).tolist()
                yield pa.RecordBatch.from_pydict({"at": pa.array([at] * len(rows), pa.int64()), "v": rows})

    spans = spark.range(0, len(found), 1, len(found)).mapInArrow(span, "at bigint, v array<double>").collect()
    rows = [r["v"] for r in sorted(spans, key=lambda r: (r["at"], r["v"]))][:components]
    values = [root.value for root in found for _ in range(root.count)][:components]
    # Square roots of large numbers: scaled to even powers of two first.
    roots = [math.sqrt(v / (1 << 2 * (e := max(0, (v.numerator // v.denominator).bit_length() // 2 - 60)))) * 2.0**e for v in values]
    return Whitening(n, sums, np.array(rows), np.array(roots), np.array([float(v / trace) for v in values]))


# ---- rows


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exactly."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if largest < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _squares(y: np.ndarray) -> list[int]:
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    wide = y.astype(object)
    return (wide * wide).sum(axis=1).tolist()


def _projected(y: np.ndarray, model: Whitening) -> np.ndarray:
    return y.astype(np.float64) @ model.vectors.T / model.roots


def identity_error(spark: SparkSession, vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity; partitions add, the driver gets the sums."""
    k = len(model.roots)
    if not k:
        return 0.0

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for x in _matrices(batch.column(0)):
                z = _projected(_offsets(x, model.n, model.sums), model)
                total += np.vstack((z.sum(axis=0), z.T @ z))
        cells = [(i, j) for i in range(k + 1) for j in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"]
        )

    added = vectors.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((k + 1, k))
    for row in added.collect():
        total[row["i"], row["j"]] = row["v"]
    total /= model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whiten(docs: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every usable row and component.

    Rows whose vector is null, or has an entry that is null, not finite or too large for a long, are left out, and so
    are empty vectors. Vectors of another length than most (the shorter one on ties) are left out as well. Repeated
    rows each give their rows; in the fit they count once. Without two different vectors there is no component and so
    no row. ``deviation`` is decimal(38,0), null where it needs more digits. Further columns are not looked at.

    The scatter matrix is added up exactly in the partitions. Its characteristic polynomial, roots and components are
    found in tasks; the driver holds the matrix, the polynomial and the components, whose sizes are the dimension's.
    """
    spark = docs.sparkSession
    usable = docs.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(is_usable(F.col("v")) & (F.size("v") > 0))
    sizes = usable.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [docs.schema[id_col].dataType.simpleString(), "int", "bigint", "decimal(38,0)", "double", "double", "double"]
    if most is None:
        return spark.createDataFrame([], ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    rows = usable.where(F.size("v") == most["d"]).select("id", integers(F.col("v")).alias("x"))
    vectors = stored(rows.select("x").distinct(), "fit-list")
    model = fit(spark, vectors, most["d"], components)
    error, k = identity_error(spark, vectors, model), len(model.roots)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _matrices(batch.column(1)):
                y = _offsets(x, model.n, model.sums)
                wide = [s if s < 10**38 else None for s in _squares(y)]
                index = np.repeat(np.arange(at, at + len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(index)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, model.n)),
                        pa.array(wide, pa.decimal128(38, 0)).take(pa.array(index - at)),
                        pa.array(_projected(y, model).ravel()),
                        pa.array(np.tile(model.explained, len(x))),
                        pa.array(np.full(len(x) * k, error)),
                    ],
                    names=[f"c{i}" for i in range(7)],
                )
                at += len(x)

    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds))
    return rows.mapInArrow(project, schema).toDF(*names)
