"""Resampling towards a target distribution: hashed word-run weights, Gumbel scores, a cutoff by exact counting."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import free_names, stored
from lakeprofile.operators.ranks import global_positions

BUCKETS = 10_000
ORDERS = (1,)  # lengths of the word runs that are features
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
LEVELS = 4  # halvings that one count job decides: it counts at the 2^LEVELS - 1 midpoints that they may need
SPLIT_BYTES = 1 << 22
HELD = 1 << 20  # features that a task holds before it counts them

# Bytes that belong to words stay (capitals as small letters), all others separate; bytes of non-ASCII characters
# are all above 0x7F, so whole texts can be cut as UTF-8.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, a bounded stretch of it at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)
    at = 0
    while at < len(data):
        stop = len(data) if at + SPLIT_BYTES >= len(data) else data.rfind(b" ", at, at + SPLIT_BYTES) + 1
        if stop <= at:  # one word longer than a stretch
            stop = data.find(b" ", at + SPLIT_BYTES) + 1 or len(data)
        yield data[at:stop].split()
        at = stop


def feature_lists(text: str | None, orders: Sequence[int], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per stretch of a text: its number of words, and the buckets of the word runs that end in it."""
    carried: list[bytes] = []
    for words in word_lists(text):
        known, run = len(carried), carried + words
        found = []
        for order in orders:
            first = max(known - order + 1, 0)
            runs = run[first:] if order == 1 else list(map(b" ".join, zip(*(run[first + i :] for i in range(order)))))
            found.append(np.fromiter(map(zlib.crc32, runs), dtype=np.int64, count=len(runs)) % buckets)
        yield len(words), np.concatenate(found)
        carried = run[len(run) - min(max(orders) - 1, len(run)) :]


def bucket_counts(docs: DataFrame, text_col: str, orders: Sequence[int], buckets: int) -> np.ndarray:
    """Features per bucket over all rows. A task hands on one row per bucket, the driver gets as many in all."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(buckets, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_lists(text.as_py(), orders, buckets):
                    held.append(found)
                    size += len(found)
                if size >= HELD or len(held) >= HELD:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(filled, pa.int64()), "n": pa.array(total[filled], pa.int64())})

    counted = docs.select(F.col(text_col)).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(own: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Per bucket a thousand times the log ratio of its smoothed shares in the target and in the corpus, floored."""
    total, target, size = float(own.sum()), float(wanted.sum()), float(len(own))
    ratio = ((wanted + 1.0) * (total + size)) / ((own + 1.0) * (target + size))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def _weigher(gain: np.ndarray, orders: Sequence[int]):
    from pyspark.sql.functions import arrow_udf

    kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    @arrow_udf("n_words bigint, n_features bigint, weight bigint")
    def weigh(texts: pa.Array) -> pa.Array:
        rows = np.zeros((len(texts), 3), dtype=np.int64)
        for i, text in enumerate(texts):
            for words, found in feature_lists(text.as_py(), orders, len(gain)):
                rows[i] += (words, len(found), gain[found].sum())
        rows[:, 2] //= np.maximum(rows[:, 1], 1)
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], fields=list(kind))

    return weigh


def gumbel(id_col: Column, seed: int) -> Column:
    """The thousandfold Gumbel draw of an id, floored; it depends on the id and the seed only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    digits = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((digits + 0.5) / 4294967296.0)))


class Order(NamedTuple):
    """Sort keys, all numeric and never null; the larger value of the first key that differs stands first."""

    keys: list[Column]
    names: list[str]


def midpoints(low: int, high: int, levels: int) -> list[int]:
    """The midpoints that so many halvings of low..high may meet."""
    if levels == 0 or low >= high:
        return []
    middle = low + (high - low + 1) // 2
    return [*midpoints(low, middle - 1, levels - 1), middle, *midpoints(middle, high, levels - 1)]


def kth_largest(rows: DataFrame, key: Column, k: int, levels: int = LEVELS) -> int:
    """The ``k``-th largest value of a whole-number key, 1 <= k <= rows, by bisection of its range.

    Every job counts rows at or above midpoints, exactly; nothing is sorted, moved or sampled. Equal values count
    as often as they occur.
    """
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    low, high = ends["low"], ends["high"]
    while low < high:
        marks = midpoints(low, high, levels)
        counts = rows.agg(*[F.count_if(key >= F.lit(m)).alias(f"c{i}") for i, m in enumerate(marks)]).first()
        for mark, count in zip(marks, counts):
            if count >= k:
                low = max(low, mark)
            else:
                high = min(high, mark - 1)
    return low


def cutoff(rows: DataFrame, keys: Sequence[Column], k: int) -> list[int]:
    """Values of the first keys at the ``k``-th row in falling key order, as far as they are needed to tell it."""
    found: list[int] = []
    for key in keys:
        cut = kth_largest(rows, key, k)
        found.append(cut)
        above, ties = rows.agg(F.count_if(key > F.lit(cut)).alias("a"), F.count_if(key == F.lit(cut)).alias("t")).first()
        k -= above
        if k == ties:
            break
        rows = rows.where(key == F.lit(cut))
    return found


def reaches(keys: Sequence[Column], cut: Sequence[int]) -> Column:
    """True for rows at the cut or before it in falling key order."""
    out = keys[len(cut) - 1] >= F.lit(cut[-1])
    for key, value in zip(reversed(keys[: len(cut) - 1]), reversed(cut[:-1])):
        out = (key > F.lit(value)) | ((key == F.lit(value)) & out)
    return out


def resample(
    docs: DataFrame,
    target: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    target_col: str = "text",
    orders: Sequence[int] = ORDERS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null unless it is drawn.

    Features are all runs of ``orders`` consecutive words, hashed into ``buckets``. Weights follow from the counts of
    all rows of ``docs`` and ``target``; a score is the weight plus the Gumbel draw of the id. Of the rows with
    ``least_words`` words or more, ``percent`` in a hundred with the highest scores are drawn (rounded down).

    Null and empty texts have no features and weight 0. Ids are whole numbers; a null id draws as the text ``null``
    and stands before all others. Ties go to the smaller id, rows that share one to fewer features, then to any, so a
    repeated row is drawn as often as its copies reach. An empty corpus gives no rows; an empty target leaves the
    smoothing. Further columns of ``docs`` are not looked at.

    Scores are written once as narrow rows. The cutoff comes from repeated counts over them, so no job sorts the
    corpus; only drawn rows are range-partitioned for their ranks.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(rows, "text", orders, buckets), bucket_counts(target, target_col, orders, buckets))
    scored = rows.select("id", _weigher(gain, orders)(F.col("text")).alias("w")).select("id", "w.*")
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scores")

    number = F.coalesce(F.col("id").cast("bigint"), F.lit(0))
    keys = [F.col("score"), F.col("id").isNull().cast("int"), F.bitwise_not(number), F.bitwise_not("n_features"), F.bitwise_not("row")]
    fit = F.col("n_words") >= least_words
    wanted = scored.where(fit).count() * percent // 100
    columns = ["id", "n_words", "n_features", "weight", "score"]
    if wanted == 0:
        out = scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    else:
        drawn = fit & reaches(keys, cutoff(scored.where(fit), keys, wanted))
        rest = scored.where(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank"))
        falling = [F.bitwise_not(k).alias(f"k{i}") for i, k in enumerate(keys)]
        chosen = scored.where(drawn).select(*falling, *columns)
        placed = global_positions(chosen, chosen.columns)
        out = placed.select(*columns, (F.col("position") + 1).alias("rank")).unionByName(rest)
    return out.withColumnRenamed("id", id_col)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with all their columns; rows that share an id stay together."""
    (mark,) = free_names(docs, "__drawn")
    ranked = resample(docs, target, id_col=id_col, **options)
    chosen = ranked.where("rank is not null").select(F.col(id_col).alias(mark)).distinct()
    return docs.join(chosen, docs[id_col].eqNullSafe(chosen[mark]), "left_semi")
