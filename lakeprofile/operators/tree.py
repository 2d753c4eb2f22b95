"""The directory tree and topics borrowed from the nearest labelled files.

A path names all its ancestors, so distances in the tree need no iteration: two files meet at their lowest
common ancestor, and the labelled files nearest to a file are found by joining on ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 16


def _parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/+", ""), "/")


def _prefixes(path: Column) -> Column:
    """(node, depth) for the root (empty string, depth 0) and every prefix of a path up to the path itself."""
    parts = _parts(path)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda d: F.struct(F.array_join(F.slice(parts, F.lit(1), d), "/").alias("node"), d.alias("depth")),
    )


def edges(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct (parent, child) pairs of the tree over slash-separated paths; the root is the empty string."""
    parts = _parts(F.col(path))
    steps = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda d: F.struct(
            F.array_join(F.slice(parts, F.lit(1), d - 1), "/").alias("parent"),
            F.array_join(F.slice(parts, F.lit(1), d), "/").alias("child"),
        ),
    )
    return paths.select(F.explode(steps).alias("e")).select("e.*").distinct()


def ancestors(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, ancestor, up): every ancestor of a path, itself included, with the steps to it."""
    depth = F.size(_parts(F.col(path)))
    return (
        paths.select(path, depth.alias("_d"), F.explode(_prefixes(F.col(path))).alias("p"))
        .select(path, F.col("p.node").alias("ancestor"), (F.col("_d") - F.col("p.depth")).alias("up"))
    )


def nearest_mix(unlabelled: DataFrame, labelled: DataFrame, path: str = "path", salts: int = SALTS) -> DataFrame:
    """(path, topic, weight, distance): topics of the nearest labelled files, mixed, for each unlabelled file.

    ``labelled`` holds (path, topic, weight). All labelled files at the smallest distance count. Files of one
    directory share the answer, so it is found once per directory. Near the root an ancestor belongs to every
    directory, and one directory may hold most files: in both joins the many-row side is salted and the other
    side, one short list per ancestor or directory, repeated. A file without any labelled file in reach yields
    no row.
    """
    topic_type = labelled.schema["topic"].dataType
    depth = F.size(_parts(F.col(path)))
    below = (
        labelled.select(depth.alias("_d"), "topic", "weight", F.explode(_prefixes(F.col(path))).alias("p"))
        .groupBy(F.col("p.node").alias("ancestor"), (F.col("_d") - F.col("p.depth")).alias("down"), "topic")
        .agg(F.sum("weight").alias("weight"))
        .groupBy("ancestor", "down")
        .agg(F.collect_list(F.struct("topic", "weight")).alias("topics"))
        .groupBy("ancestor")
        .agg(F.min(F.struct("down", "topics")).alias("best"))
        .select(
            "ancestor",
            F.col("best.down").alias("down"),
            F.col("best.topics").alias("topics"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
        )
    )
    parts = _parts(F.col(path))
    parent = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    files = unlabelled.select(
        path,
        parent.alias("_parent"),
        F.pmod(F.xxhash64(path), F.lit(salts)).cast("int").alias("_salt"),
    )
    is_root = F.col("_parent") == ""
    directories = files.select("_parent").distinct()
    climb = (
        directories.select(
            "_parent",
            F.when(is_root, F.lit(0)).otherwise(F.size(_parts(F.col("_parent")))).alias("_d"),
            F.explode(
                F.when(is_root, F.array(F.struct(F.lit("").alias("node"), F.lit(0).alias("depth"))))
                .otherwise(_prefixes(F.col("_parent")))
            ).alias("p"),
        )
        .select(
            "_parent",
            F.col("p.node").alias("ancestor"),
            (F.col("_d") - F.col("p.depth") + 1).alias("up"),
            F.pmod(F.xxhash64("_parent"), F.lit(salts)).cast("int").alias("_salt"),
        )
    )
    met = climb.join(below, ["ancestor", "_salt"]).withColumn("distance", F.col("up") + F.col("down"))
    nearest = (
        met.groupBy("_parent", "distance")
        .agg(F.flatten(F.collect_list("topics")).alias("topics"))
        .groupBy("_parent")
        .agg(F.min(F.struct("distance", "topics")).alias("best"))
        .select("_parent", F.col("best.distance").alias("distance"), F.explode("best.topics").alias("t"))
        .groupBy("_parent", "distance", F.col("t.topic").cast(topic_type).alias("topic"))
        .agg(F.sum("t.weight").alias("weight"))
        .withColumn("weight", F.try_divide("weight", F.sum("weight").over(W.partitionBy("_parent"))))
    )
    mixes = (
        nearest.groupBy("_parent")
        .agg(F.first("distance").alias("distance"), F.collect_list(F.struct("topic", "weight")).alias("topics"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    return (
        files.join(mixes, ["_parent", "_salt"])
        .select(path, "distance", F.explode("topics").alias("t"))
        .select(path, "t.topic", "t.weight", "distance")
    )
