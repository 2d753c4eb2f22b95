"""Metadata records as JSON lines and as Parquet, the directory tree, and the training tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions import scalar as S

COLUMN_SCHEMA = (
    "struct<ordinal:int,name:string,n_values:bigint,n_rows:bigint,min:array<double>,max:array<double>,"
    "total:double,precision:int,avg_exact:double,avg:double,avg_compat:double>"
)
RECORD_SCHEMA = (
    "path string, modified timestamp, file string, extension string, mime_type string, checksum string, size long, "
    "extractors array<string>, delimiter string, n_rows long, headers array<string>, "
    f"columns array<{COLUMN_SCHEMA}>, "
    "topics array<struct<topic:int,weight:double>>, tags array<string>, topics_source string, error string, error_kind string"
)


def write_records(records: DataFrame, target: str, mode: str = "append") -> None:
    """One JSON object per file, a line each."""
    records.write.mode(mode).json(target)


def read_records(spark: SparkSession, source: str) -> DataFrame:
    return spark.read.schema(RECORD_SCHEMA).json(source)


def records_to_json(records: DataFrame) -> DataFrame:
    """(path, json): each record as one JSON text."""
    return records.select("path", F.to_json(F.struct("*")).alias("json"))


def write_tree(edges: DataFrame, target: str) -> None:
    edges.write.mode("overwrite").parquet(target)


def read_tree(spark: SparkSession, source: str) -> DataFrame:
    return spark.read.schema("parent string, child string").parquet(source)


def training_columns(columns: DataFrame) -> DataFrame:
    """The rows of the training CSV: path, file, column, ten features, average, and an empty sentinel."""
    features = S.extreme_features(F.col("min"), F.col("max"))
    return columns.select(
        S.directory(F.col("path")).alias("path"),
        S.file_name(F.col("path")).alias("file"),
        F.lower("name").alias("column"),
        *[v.alias(k) for k, v in features.items()],
        F.col("avg").alias("avg"),
        F.lit(None).cast("double").alias("null"),
    )


def write_training_csv(columns: DataFrame, target: str) -> None:
    write_training_rows(training_columns(columns), target)


def write_training_rows(rows: DataFrame, target: str) -> None:
    """Rows of `training_columns`, with or without sentinels filled in, as CSV with a header line."""
    rows.write.mode("overwrite").option("header", True).csv(target)


def read_training_csv(spark: SparkSession, source: str, label: str, features: Sequence[str]) -> DataFrame:
    """(id, label, fields): the feature fields as text, for `lakeprofile.operators.cleaning.clean_features`."""
    names = ["path", "file", "column", *S.FEATURE_NAMES, "avg", "null"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.option("header", True).schema(schema).csv(source)
    return rows.select(
        F.concat_ws("|", "path", "file", "column").alias("id"),
        F.col(label).alias("label"),
        F.array(*[F.col(f) for f in features]).alias("fields"),
    )
