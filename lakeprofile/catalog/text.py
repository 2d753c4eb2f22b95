"""Words, bags of words and topic lists over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.catalog import Entry, sql, table
from lakeprofile.functions import scalar as S
from lakeprofile.operators import text as X


def _words(spark, sf):
    tokens = X.tokenize(table(spark, sf, "documents"))
    return tokens.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_words"),
        (F.size("tokens") > 0).alias("has_words"),
        F.sha2(F.array_join("tokens", " ").cast("binary"), 256).alias("checksum"),
    )


_TOKENS = "regexp_extract_all(regexp_replace(text, '<[^\\r\\n]+>', '', 'g'), '[a-zA-Z]{3,}')"
WORDS_SQL = f"""
with t as (select doc_id, {_TOKENS} as tokens from documents)
select doc_id, len(tokens) as n_words, len(tokens) > 0 as has_words,
       sha256(coalesce(array_to_string(tokens, ' '), '')) as checksum from t"""


def bag(spark, sf) -> DataFrame:
    return X.bag_of_words(table(spark, sf, "documents"), "doc_id")


_BAG = f"bag as (select doc_id, term, count(*) as n from (select doc_id, unnest({_TOKENS}) as term from documents) group by all)"
_VOCAB = """
counts as (select term, count(*) as n_docs, sum(n)::bigint as n from bag group by all),
vocab as (select term, row_number() over (order by n desc, term) - 1 as term_id, n_docs, n
          from counts)"""


def _vocabulary(spark, sf):
    return X.vocabulary(bag(spark, sf))


def encoded(spark, sf) -> DataFrame:
    """(doc_id, term_id, n) for all words."""
    words = bag(spark, sf)
    return X.encode(words, X.vocabulary(words))


_ENCODED = "encoded as (select doc_id, term_id, bag.n from bag join vocab using (term))"


def weighted(spark, sf) -> DataFrame:
    """(doc_id, topic, weight): the final letter of the word stands in for its topic."""
    words = bag(spark, sf)
    topic = (F.ascii(F.lower(F.right("term", F.lit(1)))) - 97).cast("int")
    return words.groupBy("doc_id", topic.alias("topic")).agg(F.sum("n").cast("double").alias("weight"))


_WEIGHTED = """
weighted as (select doc_id, ascii(lower(right(term, 1))) - 97 as topic, sum(n)::double as weight from bag group by all)"""


def _normalise(spark, sf):
    lists = X.topic_lists(weighted(spark, sf), "doc_id").withColumn("topics", S.normalise(F.col("topics")))
    return (
        lists.select("doc_id", F.explode("topics").alias("t"))
        .select("doc_id", "t.topic", S.round_half_away(F.col("t.weight"), F.lit(9)).alias("weight"))
    )


NORMALISE_SQL = f"""
with {_BAG}, {_WEIGHTED},
s as (select doc_id, topic, weight / sum(weight) over (partition by doc_id) as w from weighted)
select doc_id, topic, {sql.rounded('w', 9)} as weight from s"""


def _strongest(spark, sf):
    return X.strongest(weighted(spark, sf), "doc_id")


STRONGEST_SQL = f"""
with {_BAG}, {_WEIGHTED},
r as (select *, row_number() over (partition by doc_id order by weight desc, topic) as k from weighted)
select doc_id, topic, weight from r where k = 1"""


def _mix(spark, sf):
    """Topics of all documents of one source, mixed."""
    sources = table(spark, sf, "documents").select("doc_id", "source")
    mixed = X.mix_topics(weighted(spark, sf).join(sources, "doc_id"), "source")
    return mixed.withColumn("weight", S.round_half_away(F.col("weight"), F.lit(9)))


MIX_SQL = f"""
with {_BAG}, {_WEIGHTED},
s as (select source, topic, sum(weight) as weight from weighted join documents using (doc_id) group by all),
n as (select source, topic, weight / sum(weight) over (partition by source) as w from s)
select source, topic, {sql.rounded('w', 9)} as weight from n"""

ENTRIES = [
    Entry("word_tokens", _words, WORDS_SQL),
    Entry("bag_of_words", bag, f"with {_BAG} select * from bag"),
    Entry("vocabulary", _vocabulary, f"with {_BAG}, {_VOCAB} select * from vocab"),
    Entry("encoded_words", encoded, f"with {_BAG}, {_VOCAB}, {_ENCODED} select * from encoded"),
    Entry("normalise_topics", _normalise, NORMALISE_SQL),
    Entry("strongest_topic", _strongest, STRONGEST_SQL),
    Entry("mix_topics", _mix, MIX_SQL),
]
