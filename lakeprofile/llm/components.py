"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """Node and label for every node of ``links`` (columns a and b): the label is the smallest node of its component.

    Each round sends a node to the smallest node among itself and its neighbours and contracts the links; it ends when
    none is left. Minima are taken in the tasks first, so a node with most of the links is no hot group.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "edges")
    both = edges.union(edges.select("b", "a"))
    found = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    found = stored(found, "labels")
    step = found
    while True:
        to_a = step.select(F.col("node").alias("a"), F.col("label").alias("x"))
        to_b = step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        edges = edges.join(to_a, "a").join(to_b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = stored(edges.where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return found
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
        step = stored(step, "labels")
        further = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        found = found.join(further, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        found = stored(found, "labels")
