"""Words, bags of words and topic lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeprofile.functions import scalar as S
from lakeprofile.functions.rows import explode_computed
from lakeprofile.operators.ranks import global_positions


def tokenize(docs: DataFrame, text: str = "text", into: str = "tokens") -> DataFrame:
    """Add the words of the tag-free text; empty documents keep an empty list."""
    return docs.withColumn(into, S.words(S.strip_tags(F.col(text))))


def bag_of_words(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, n): occurrences of each word of each document.

    The texts of a key are moved to one task and counted there: a text is several times smaller than the rows of its words.
    """
    together = docs.select(key, text).repartition(key)
    tokens = explode_computed(tokenize(together, text), "tokens", "term", key)
    return tokens.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(bag: DataFrame, min_docs: int = 1) -> DataFrame:
    """(term, term_id, n_docs, n) of all terms, ids by falling count, then by term; sorted by ranges."""
    counts = bag.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))
    falling = counts.filter(F.col("n_docs") >= min_docs).select((-F.col("n")).alias("_n"), "term", "n_docs")
    placed = global_positions(falling, ["_n", "term", "n_docs"])
    return placed.select("term", F.col("position").alias("term_id"), "n_docs", (-F.col("_n")).alias("n"))


def encode(bag: DataFrame, vocab: DataFrame) -> DataFrame:
    """Replace terms by their ids; terms that the dictionary lacks drop out.

    Neither side is bounded, so the join is left to the optimizer; a frequent term is split as a skewed key.
    """
    return bag.join(vocab.select("term", "term_id"), "term").drop("term")


def mix_topics(topics: DataFrame, item: str) -> DataFrame:
    """Sum the weights per item and topic and scale them to one per item."""
    summed = topics.groupBy(item, "topic").agg(F.sum("weight").alias("weight"))
    share = F.try_divide(F.col("weight"), F.sum("weight").over(W.partitionBy(item)))
    return summed.withColumn("weight", share)


def strongest(topics: DataFrame, item: str) -> DataFrame:
    """Topic of the largest weight per item, the smaller topic on equal weights."""
    best = F.max_by("topic", F.struct("weight", -F.col("topic")))
    return topics.groupBy(item).agg(best.alias("topic"), F.max("weight").alias("weight"))


def topic_lists(topics: DataFrame, item: str) -> DataFrame:
    """One row per item with its topics in topic order; as long as the model has topics."""
    ordered = F.sort_array(F.collect_list(F.struct("topic", "weight")))
    return topics.groupBy(item).agg(ordered.alias("topics"))
