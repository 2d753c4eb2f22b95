"""A pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.llm import decontamination, jaccard_join, language_id, line_dedup, sentencepiece_codec
from lakeprofile.llm.catalog import TOKENIZERS
from lakeprofile.llm.common import stored

LEAST_SCORE = 0.2  # documents further from every learned language are rejected
BATCH_BYTES = 1 << 20  # of rows that a stage hands to Python at once; it may return several times as many


def bounded_batches(spark: SparkSession) -> None:
    """Cuts the batches of this session that go to Python by bytes. Several stages share the Python workers of an
    executor, and what a worker holds follows from the bytes of its batches, not from their number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and, where labels teach any language, those that are near none.

    Null, empty and blank texts have no letters and go. Repeated rows stay or go together; an empty table stays empty.
    """
    bounded_batches(spark)
    profiles = language_id.learn(docs)
    if not profiles.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    done = language_id.predict(docs, profiles, out_col="__language")
    known = (F.col("__language.lang_pred") != language_id.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)
    return done.where(known).select(*docs.columns)


def delete_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; documents that consist of such lines only go.

    Of equal runs the one in the smallest id stays, so of repeated rows one keeps its lines. A null text has no lines and
    stays as it is, an empty one stays too; an empty table stays empty.
    """
    bounded_batches(spark)
    done = line_dedup.delete_repeated_runs(docs, count_col="__deleted")
    left = (F.col("__deleted") == 0) | (F.col("text") != "")
    return done.where(left).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words a shingle, similarity 0.8).

    It is the one with the smallest id, a null id coming last; of rows equal in id and text one stays. Null and empty
    texts and those without words are like nothing and stay; an empty table stays empty.
    """
    bounded_batches(spark)
    return jaccard_join.keep_first(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes contaminated documents: a word in twenty or more lies in windows of the benchmark.

    Null and empty texts have no words and stay. Repeated rows stay or go together; an empty table stays empty.
    """
    bounded_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it again.

    A null text has no ids and a null ``round_trip``, an empty one no ids and a true one. Repeated rows each have their
    row; an empty table gives none.
    """
    bounded_batches(spark)
    done = sentencepiece_codec.encode_decode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return done.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip")
    )


STAGES = [
    ("language ID", language),
    ("line dedup", delete_lines),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

# Not expressible in SQL: profiles of languages, suffix ranks and merge rounds; tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
