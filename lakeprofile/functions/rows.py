"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_computed(df: DataFrame, array: str, alias: str, *keys: str) -> DataFrame:
    """(keys, alias): one row per element of an array that is expensive to compute.

    For a plain explode the optimizer tests the size of the array below the projection that computes it, and so
    computes it twice. The outer form has no such test; the rows of empty arrays are dropped afterwards.
    """
    return df.select(*keys, F.explode_outer(array).alias(alias)).filter(F.col(alias).isNotNull())
