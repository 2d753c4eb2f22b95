"""Exact global positions without sending a table through one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.session import ensure_checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its lower 33 bits


def global_positions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key columns of ``df`` with their zero-based ``position`` in key order and the row count ``n``.

    Rows are range-partitioned and sorted inside partitions; only one count per partition is accumulated in
    order, on the driver, so that positions need no further exchange. The sorted keys are checkpointed so that counts
    and positions come from the same partitioning.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = list(keys)
    ranged = (
        df.select(*keys)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", _ROW_BITS))
        .withColumn("_row", F.col("_id") - F.shiftleft(F.col("_part"), _ROW_BITS))
        .drop("_id")
        .checkpoint()
    )
    # One count per partition of the sort: their number does not depend on the table.
    counts = dict(ranged.groupBy("_part").agg(F.count(F.lit(1))).collect())
    before = list(accumulate((counts.get(part, 0) for part in range(max(counts, default=0) + 1)), initial=0))
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    return ranged.select(
        *keys,
        (F.get(offsets, F.col("_part").cast("int")) + F.col("_row")).alias("position"),
        F.lit(before[-1]).cast("bigint").alias("n"),
    )
