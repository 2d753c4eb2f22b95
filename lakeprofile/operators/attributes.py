"""Inventory of attributes and dimensions of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_attributes(df: DataFrame, column: str) -> DataFrame:
    """(scope, name, type, n): attributes of JSON objects with their type and the number of records.

    Top-level attributes have scope ``global``; those inside an object have the name of the object as scope.
    Unparsable text contributes nothing.
    """
    def members(source: DataFrame, value: str) -> DataFrame:
        return source.sparkSession.sql(
            "SELECT s.*, e.key AS _key, e.value AS _value FROM {source} s, LATERAL variant_explode(s.{value}) e",
            source=source,
            value=source[value],
        )

    parsed = df.select(F.try_parse_json(F.col(column)).alias("_root")).filter(F.col("_root").isNotNull())
    top = members(parsed, "_root").select(
        F.lit("global").alias("scope"), F.col("_key").alias("name"), "_value",
        F.schema_of_variant("_value").alias("type"),
    )
    inner_source = top.filter(F.col("type").startswith("OBJECT")).select(
        F.col("name").alias("_outer"), F.col("_value").alias("_inner")
    )
    inner = members(inner_source, "_inner").select(
        F.col("_outer").alias("scope"), F.col("_key").alias("name"), "_value",
        F.schema_of_variant("_value").alias("type"),
    )
    return (
        top.unionByName(inner)
        .withColumn("type", F.regexp_extract("type", r"^([A-Z]+)", 1))
        .groupBy("scope", "name", "type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def dimensions(df: DataFrame) -> DataFrame:
    """(name, type, element_type, size_min, size_max, n): shape of each array column of a table."""
    arrays = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    stats = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f.name).alias("name"),
                        F.lit("array").alias("type"),
                        F.lit(f.dataType.elementType.simpleString()).alias("element_type"),
                        F.size(F.col(f.name)).alias("size"),
                    )
                    for f in arrays
                ]
            )
        ).alias("d")
    ).select("d.*")
    return stats.groupBy("name", "type", "element_type").agg(
        F.min("size").alias("size_min"), F.max("size").alias("size_max"), F.count("size").alias("n")
    )


def variables(df: DataFrame) -> DataFrame:
    """(name, type, n): every column of a table with its type and number of values."""
    columns = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.count(F.col(f.name)).alias("n"),
            )
            for f in df.schema.fields
        ]
    )
    return df.agg(columns.alias("_c")).select(F.explode("_c").alias("c")).select("c.*")
