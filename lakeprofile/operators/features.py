"""Column features for the sentinel and name models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions import scalar as S


def column_features(profile: DataFrame) -> DataFrame:
    """Add the ten-wide ``features`` array to a column profile (min, max)."""
    return profile.withColumn("features", S.feature_array(F.col("min"), F.col("max")))


def feature_columns(profile: DataFrame) -> DataFrame:
    """Add the ten features as columns with NULL for what is missing, the form of the training CSV."""
    return profile.withColumns(S.extreme_features(F.col("min"), F.col("max")))
