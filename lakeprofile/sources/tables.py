"""Reading structured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A Parquet table. ``spread_by`` names the key of a table whose rows are expensive to work on.

    Such a table is hash-partitioned by that key if it has fewer splits than the session has cores, as with one
    small file; a table of many splits is scanned as it is, without a shuffle.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread_by is None or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, spread_by)
