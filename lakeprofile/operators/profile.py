"""Numeric column profiles: three smallest and three largest distinct values, total and averages.

Two input shapes, two strategies, one result:

* a structured table (`profile_columns`) is scanned once; each task folds its rows into a bounded state per column,
  so nothing but a few rows per task and column is ever shuffled, whatever the table holds;
* long cells keyed by file and ordinal (`profile_cells`) are reduced inside each task, batch by batch, to at
  most six candidates per column before the first shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions import scalar as S
from lakeprofile.session import ensure_checkpoint_dir

# The functions below run in Python workers, where this package need not be installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXTREMES = 3


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _finite(value: Column) -> Column:
    value = value.cast("double") + F.lit(0.0)
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def averages(total: Column, n_values: Column, n_rows: Column, smallest: Column, largest: Column) -> dict[str, Column]:
    """Average columns of a profile.

    ``avg`` divides by the values counted, ``avg_compat`` by the value rows; both are shown with the decimals
    of the most precise extreme. ``avg_exact`` is ``avg`` before rounding.
    """
    places = S.max_precision(F.concat(smallest, largest))
    return {
        "precision": places.cast("int"),
        "avg_exact": F.try_divide(total, n_values),
        "avg": S.round_half_away(F.try_divide(total, n_values), places),
        "avg_compat": F.when(n_values > 0, S.round_half_away(F.try_divide(total, n_rows), places)),
    }


def _smallest(values: np.ndarray) -> np.ndarray:
    """The smallest distinct values, rising."""
    found = []
    while len(values) and len(found) < EXTREMES:
        found.append(values.min())
        values = values[values > found[-1]]
    return np.array(found)


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bounded state of each column over all batches of a task, as rows (ordinal, side, value, total, counts).

    Side 0 holds the sums, side 1 the smallest values and side 2 the negated largest ones.
    """
    n_rows, states = 0, []
    for batch in batches:
        states = states or [[0.0, 0, np.zeros(0), np.zeros(0)] for _ in batch.columns]
        n_rows += batch.num_rows
        for state, column in zip(states, batch.columns):
            values = column.drop_null().to_numpy(zero_copy_only=False)
            if len(values):
                state[0] += values.sum()
                state[1] += len(values)
                state[2] = _smallest(np.concatenate((state[2], _smallest(values))))
                state[3] = _smallest(np.concatenate((state[3], _smallest(-values))))
    rows = []
    for i, (total, n, low, high) in enumerate(states):
        rows.append((i, 0, None, total, n, n_rows))
        rows += [(i, side, float(v), 0.0, 0, 0) for side, values in ((1, low), (2, high)) for v in values]
    if rows:
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["ordinal", "side", "value", "total", "n_values", "n_rows"])


def profile_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    sentinels: Mapping[str, float] | None = None,
) -> DataFrame:
    """Profile the numeric columns of a structured table, one result row per column, in one scan.

    A sentinel given for a column hides the values within one unit of it. Each task folds its rows into three distinct
    extremes a side, a sum and counts per column and hands on seven rows a column; these are merged by value, ranked
    with the limit applied before the shuffle, and gathered. Nothing runs while the plan is built.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    sentinels = sentinels or {}
    values = df.select(
        *[
            S.without_sentinel(_finite(F.col(c)), F.lit(sentinels.get(c)).cast("double")).alias(f"v{i}")
            for i, c in enumerate(columns)
        ]
    )
    schema = "ordinal int, side int, value double, total double, n_values long, n_rows long"
    sums = [F.sum(c).alias(c) for c in ("total", "n_values", "n_rows")]
    merged = values.mapInArrow(_fold, schema).groupBy("ordinal", "side", "value").agg(*sums)
    rank = F.row_number().over(W.partitionBy("ordinal", "side").orderBy("value"))
    best = merged.withColumn("rank", rank).filter(F.col("rank") <= EXTREMES)

    def side(number: int) -> Column:
        found = F.collect_list(F.when(F.col("side") == number, F.col("value")))
        return F.sort_array(found)

    gathered = best.groupBy("ordinal").agg(
        *sums, side(1).alias("min"), F.transform(side(2), lambda v: F.lit(0.0) - v).alias("max")
    )
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "ordinal int, name string")
    empty = F.array().cast("array<double>")
    found = names.join(F.broadcast(gathered), "ordinal", "left")  # one row per column on either side
    long = found.select(
        "ordinal", "name",
        F.coalesce("n_values", F.lit(0)).alias("n_values"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("min", empty).alias("min"),
        F.coalesce("max", empty).alias("max"),
        F.when(F.col("n_values") > 0, F.col("total")).alias("total"),
    )
    return with_averages(long)


def with_averages(profile: DataFrame) -> DataFrame:
    """Add the average columns to (n_values, n_rows, min, max, total)."""
    return profile.withColumns(
        averages(F.col("total"), F.col("n_values"), F.col("n_rows"), F.col("min"), F.col("max"))
    )


def profile_cells(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Fold long cells into (keys, n_values, min, max, total).

    Each task first reduces its Arrow batches to the three smallest and largest distinct values per key plus a
    partial sum, so a key holding most of the cells costs a few rows per batch. Deduplication then spreads by
    key and value, and the ranking applies its limit before its own shuffle. The deduplicated candidates are
    checkpointed: totals and both rankings start from them, and the cells are computed once.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    keys = list(keys)
    narrow = cells.select(*keys, F.col(value).cast("double").alias("value"))

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(keys, sort=False, dropna=False)["value"]
            sums = groups.agg(total="sum", n_values="count").reset_index()
            sums["value"] = float("nan")
            distinct = batch.dropna(subset=["value"]).drop_duplicates(keys + ["value"]).sort_values("value")
            per_key = distinct.groupby(keys, sort=False, dropna=False)
            kept = pd.concat([per_key.head(EXTREMES), per_key.tail(EXTREMES)])
            kept = kept.drop_duplicates(keys + ["value"]).assign(total=0.0, n_values=0)
            yield pd.concat([sums, kept])[keys + ["value", "total", "n_values"]]

    schema = T.StructType(
        [narrow.schema[k] for k in keys]
        + [
            T.StructField("value", T.DoubleType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("n_values", T.LongType()),
        ]
    )
    reduced = narrow.mapInPandas(reduce_batches, schema).withColumn(
        "value", F.when(~F.isnan("value"), F.col("value"))
    )
    candidates = (
        reduced.groupBy(*keys, "value")
        .agg(F.sum("total").alias("total"), F.sum("n_values").alias("n_values"))
        .checkpoint()
    )
    totals = candidates.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n_values").alias("n_values"))

    def side(name: str, order: Column) -> DataFrame:
        ranked = candidates.filter(F.col("value").isNotNull()).withColumn(
            "rank", F.row_number().over(W.partitionBy(*keys).orderBy(order))
        )
        return (
            ranked.filter(F.col("rank") <= EXTREMES)
            .groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias(name))
            .withColumn(name, F.transform(name, lambda x: x["value"]))
        )

    smallest, largest = side("min", F.col("value").asc()), side("max", F.col("value").desc())
    empty = F.array().cast("array<double>")
    return (
        totals.join(smallest, keys, "left")
        .join(largest, keys, "left")
        .select(
            *keys,
            "n_values",
            F.coalesce("min", empty).alias("min"),
            F.coalesce("max", empty).alias("max"),
            "total",
        )
    )
