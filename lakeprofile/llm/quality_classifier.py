"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically."""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import light, stored

SAMPLE = 100_000  # labelled documents that a model is fitted on, about; None takes all
FEATURES = 192  # random Fourier features
RIDGE = 1.0
FOLDS = 4  # calibration sees scores of models that were fitted without the row
BINS = 1_024  # of raw scores in calibration, from RAW_LOW to RAW_HIGH
RAW_LOW, RAW_HIGH = -0.5, 1.5
CLIP = 6.0  # standard deviations beyond which a statistic says no more
TIE = 1e-3  # share of the raw score in the result: keeps the order within a calibrated step
SEED = 12
ROWS_PER_TASK = 8_192

NAMES = (
    "characters", "words", "word_length", "word_spread", "letters", "digits", "blanks", "symbols", "punctuation",
    "capitals", "letterless_words", "symbol_endings", "long_words", "distinct_words", "top_word", "echoes",
    "word_entropy", "lines", "line_length", "repeated_lines", "closed_lines", "blank_lines", "byte_entropy", "sentences",
)

_LOWER, _UPPER, _DIGIT, _BLANK, _FEED, _MARK, _SYMBOL, _WIDE, _INNER = range(9)
_CLOSERS = b".!?"
_KINDS = np.full(256, _SYMBOL, dtype=np.uint8)
for _chars, _kind in (
    (range(97, 123), _LOWER), (range(65, 91), _UPPER), (range(48, 58), _DIGIT), (b" \t\r\x0b\x0c", _BLANK), (b"\n", _FEED),
    (b".,;:!?'\"-()", _MARK), (range(0xC0, 0x100), _WIDE), (range(0x80, 0xC0), _INNER),
):
    _KINDS[list(_chars)] = _kind
_IS_LETTER = np.isin(_KINDS, (_LOWER, _UPPER, _WIDE))
_IS_BLANK = np.isin(_KINDS, (_BLANK, _FEED))


def _entropy(counts: np.ndarray) -> float:
    share = counts[counts > 0] / counts.sum()
    return float(-(share * np.log2(share)).sum())


def statistics(text: str | None) -> np.ndarray:
    """The numbers of `NAMES` for a whole text; all zero if it holds nothing but blanks."""
    out = np.zeros(len(NAMES))
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return out
    codes = np.frombuffer(data, dtype=np.uint8)
    of_byte = np.bincount(codes, minlength=256)
    kinds = np.bincount(_KINDS, weights=of_byte, minlength=9)
    n_chars, n = len(codes) - kinds[_INNER], len(words)
    letters = kinds[_LOWER] + kinds[_UPPER] + kinds[_WIDE]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    last = _KINDS[np.fromiter((w[-1] for w in words), dtype=np.uint8, count=n)]
    blank = _IS_BLANK[codes]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    lettered = np.logical_or.reduceat(_IS_LETTER[codes], starts)
    counts = np.fromiter(Counter(words).values(), dtype=np.int64)
    lines = data.split(b"\n")
    filled = [s for x in lines if (s := x.strip())]
    out[:] = (
        math.log1p(n_chars), math.log1p(n), lengths.mean(), lengths.std(), letters / n_chars, kinds[_DIGIT] / n_chars,
        (kinds[_BLANK] + kinds[_FEED]) / n_chars, kinds[_SYMBOL] / n_chars, kinds[_MARK] / n_chars,
        kinds[_UPPER] / max(letters, 1), 1 - lettered.mean(), (last == _SYMBOL).mean(),
        (lengths > 20).mean(), len(counts) / n, counts.max() / n, sum(map(operator.eq, words, words[1:])) / n,
        _entropy(counts) / max(math.log2(n), 1), math.log1p(len(lines)), math.log1p(n_chars / len(lines)),
        1 - len(set(filled)) / len(filled), sum(x[-1] in _CLOSERS for x in filled) / len(filled),
        1 - len(filled) / len(lines), _entropy(of_byte), math.log1p(of_byte[list(_CLOSERS)].sum()) - math.log1p(n),
    )
    return out


def statistics_column():
    """Column function: text to its statistics (array<double>)."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        rows = [statistics(text.as_py()) for text in texts]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return stats


class Model(NamedTuple):
    """Standardisation, projections, ridge weights and the steps of the calibration."""

    mean: np.ndarray
    spread: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray  # of the Fourier features and a constant
    steps: tuple[np.ndarray, np.ndarray]  # raw scores and the chance of a good text there

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        """Features whose inner products approximate a Gaussian kernel over the standardised statistics."""
        at = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        waves = np.cos(at @ self.projection + self.phase) * math.sqrt(2 / len(self.phase))
        return np.hstack((waves, np.ones((len(stats), 1))))

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.fourier(stats) @ self.weights
        place = np.clip((raw - RAW_LOW) / (RAW_HIGH - RAW_LOW), 0, 1)
        return (1 - TIE) * np.interp(raw, *self.steps) + TIE * place


def _table(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(cells: DataFrame, keys: list[str]) -> list:
    return cells.groupBy(*keys).agg(F.sum("v").alias("v")).collect()


def _normal_equations(rows: DataFrame, blank: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per fold: the products of the features with each other and with the labels, added up by partition."""
    size = len(blank.phase) + 1
    upper = np.triu_indices(size + 1)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size + 1, size + 1))
        for batch in batches:
            fold, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wide = np.hstack((blank.fourier(_table(batch.column(2))), label[:, None]))
            for f in range(FOLDS):
                mine = wide[fold == f]
                total[f] += mine.T @ mine
        for f in range(FOLDS):
            values = total[f][upper]
            cells = [pa.array(np.full(len(values), f, dtype=np.int32)), pa.array(np.arange(len(values), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(values)], names=["f", "c", "v"])

    out = np.zeros((FOLDS, size + 1, size + 1))
    for row in _summed(rows.mapInArrow(add, "f int, c int, v double"), ["f", "c"]):
        i, j = upper[0][row["c"]], upper[1][row["c"]]
        out[row["f"], i, j] = out[row["f"], j, i] = row["v"]
    return out[:, :size, :size], out[:, :size, size]


def pooled(low: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of good / n over rising scores: neighbours that fall are pooled.

    Returned as points, one at the mean score of each pool, between which the calibration is straight.
    """
    pools: list[list[float]] = []
    for s, g, w in zip(low.tolist(), good.tolist(), n.tolist()):
        pools.append([s * w, g, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    table = np.array(pools)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def _calibration(rows: DataFrame, blank: Model, by_fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BINS))
        for batch in batches:
            fold, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw = np.einsum("ij,ij->i", blank.fourier(_table(batch.column(2))), by_fold[fold])
            place = np.clip(raw, RAW_LOW, RAW_HIGH)
            at = np.minimum(((place - RAW_LOW) / (RAW_HIGH - RAW_LOW) * BINS).astype(np.int64), BINS - 1)
            for k, weight in enumerate((np.ones(len(raw)), label, place)):
                total[k] += np.bincount(at, weights=weight, minlength=BINS)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b])], names=["k", "b", "v"]
        )

    total = np.zeros((3, BINS))
    for row in _summed(rows.mapInArrow(count, "k int, b int, v double"), ["k", "b"]):
        total[row["k"], row["b"]] = row["v"]
    filled = total[0] > 0
    n, good, sums = total[:, filled]
    return pooled(sums / n, good, n)


def learn(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    sample: int | None = SAMPLE,
    features: int = FEATURES,
    seed: int = SEED,
) -> Model | None:
    """A model of stored statistics (id, ``stats``) and labels (id, 0 or 1), None if no document has a label.

    Labels without id or value teach nothing. A repeated label counts as the mean of its copies, a repeated document
    once. Of more than ``sample`` labels a share is taken by a hash of their ids. The driver holds the matrix of
    ``features`` squared per fold, and `BINS` counts.
    """
    spark = stats.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    known = stored(known.groupBy("id").agg(F.avg("label").alias("label")), "labels")
    total = known.count()
    if sample is not None and total > sample:
        draw = F.pmod(F.xxhash64("id", F.lit("quality sample")), F.lit(1 << 30))
        known = known.where(draw < (sample << 30) // total)
    # Broadcast only if the sample is as small as its parameter says.
    taught = stats.select(F.col(id_col).alias("id"), "stats").join(light(known, 2 * SAMPLE), "id")
    rows = taught.groupBy("id").agg(F.min("stats").alias("stats"), F.min("label").alias("label"))
    fold = F.pmod(F.xxhash64("id", F.lit("quality fold")), F.lit(FOLDS)).cast("int")
    rows = stored(rows.select(fold.alias("fold"), "label", "stats"), "taught")
    n = rows.count()
    if n == 0:
        return None
    rows = rows.coalesce(max(1, -(-n // ROWS_PER_TASK)))
    each = [F.get("stats", F.lit(i)) for i in range(len(NAMES))]
    moments = rows.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    mean, spread = np.array(moments[: len(NAMES)]), np.array(moments[len(NAMES) :])
    random = np.random.default_rng(seed)
    blank = Model(
        mean,
        np.where(spread > 1e-9, spread, 1.0),
        random.normal(size=(len(NAMES), features)) / math.sqrt(len(NAMES)),
        random.uniform(0, 2 * math.pi, features),
        np.zeros(features + 1),
        (np.zeros(1), np.zeros(1)),
    )
    products, answers = _normal_equations(rows, blank)
    ridge = RIDGE * np.eye(features + 1)
    ridge[-1, -1] = 1e-6  # the constant is not held back
    gram, answer = products.sum(axis=0), answers.sum(axis=0)
    by_fold = np.array([np.linalg.solve(gram - products[f] + ridge, answer - answers[f]) for f in range(FOLDS)])
    model = blank._replace(weights=np.linalg.solve(gram + ridge, answer))
    return model._replace(steps=_calibration(rows, model, by_fold))


def _scorer(spark, model: Model | None):
    from pyspark.sql.functions import arrow_udf

    shared = spark.sparkContext.broadcast(model)  # features x statistics numbers

    @arrow_udf("double")
    def score(stats: pa.Array) -> pa.Array:
        own = shared.value
        if own is None or not len(stats):
            return pa.array(np.full(len(stats), 0.5))
        return pa.array(own.score(_table(stats)))

    return score


def score(stats: DataFrame, model: Model | None, stats_col: str = "stats", out_col: str = "score") -> DataFrame:
    """``stats`` with the chance, from 0 to 1, that the text is good; 0.5 throughout if nothing was learned."""
    return stats.withColumn(out_col, _scorer(stats.sparkSession, model)(F.col(stats_col)))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    sample: int | None = SAMPLE,
) -> DataFrame:
    """(id, score) of every row of ``docs``, learned from the labels given.

    Whole texts are read once; their statistics are stored as narrow rows, which both the fit and the scores use.
    Neither id nor label is an input of a score. Null, empty and blank texts have statistics of zero and are scored
    by them. Repeated rows have equal scores; no labels give 0.5; further columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), statistics_column()(F.col(text_col)).alias("stats"))
    stats = stored(rows, "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    model = learn(stats, known, "id", "label", sample)
    return score(stats, model).select(F.col("id").alias(id_col), "score")
