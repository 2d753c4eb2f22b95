"""Topic model: training, inference and tags with MLlib."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions import patterns as P
from lakeprofile.functions import scalar as S
from lakeprofile.operators.text import tokenize
from lakeprofile.plans.wide_topics import WideTopicModel, train_wide
from lakeprofile.sources.stores import stored

TAG_WORDS = 10
LARGEST_DICTIONARY = 2_000_000
ITERATIONS = 5


class TopicModel(NamedTuple):
    vectorizer: CountVectorizerModel
    lda: LDAModel

    def save(self, folder: str) -> None:
        self.vectorizer.write().overwrite().save(f"{folder}/vectorizer")
        self.lda.write().overwrite().save(f"{folder}/lda")

    @staticmethod
    def load(folder: str) -> TopicModel:
        return TopicModel(
            CountVectorizerModel.load(f"{folder}/vectorizer"), LocalLDAModel.load(f"{folder}/lda")
        )

    def tag_map(self) -> Column:
        """Map from topic to its top words; as large as topics times ten words."""
        words = self.vectorizer.vocabulary
        pairs = []
        for row in self.lda.describeTopics(TAG_WORDS).collect():
            pairs += [F.lit(row["topic"]), F.array(*[F.lit(words[i]) for i in row["termIndices"]])]
        return F.create_map(*pairs)


def train_topics(
    docs: DataFrame, k: int = 10, largest: int = LARGEST_DICTIONARY, seed: int = 7, iterations: int = ITERATIONS, text: str = "text"
) -> TopicModel | WideTopicModel:
    """Fit a dictionary and an LDA model on all words of all documents; every iteration uses every document.

    Texts are cut once and the words stored; dictionary and counts come from there. As each step sees the whole corpus,
    steps are long from the start (learning offset 1): a few of them fit better than many short ones.

    MLlib keeps the dictionary on the driver and a weight per word and topic in each task, so a corpus with more than
    ``largest`` different words takes the form whose words are rows (`lakeprofile.plans.wide_topics`); words are never cut.
    """
    # Documents without words stay: a filter on the words would cut every text twice, and both models skip them.
    tokens = stored(tokenize(docs, text).select("tokens"), "tokens")
    if tokens.select(F.explode("tokens").alias("term")).distinct().count() > largest:
        texts = tokens.select(F.monotonically_increasing_id().alias("_text"), F.col("tokens").alias("terms"))
        return train_wide(texts, "_text", k, seed, iterations)
    vectorizer = CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=largest).fit(tokens)
    lda = LDA(
        k=k, seed=seed, maxIter=iterations, optimizer="online", subsamplingRate=1.0, learningOffset=1.0, featuresCol="counts"
    )
    # Every iteration passes over the counts, which are read from storage instead of counted again.
    return TopicModel(vectorizer, lda.fit(stored(vectorizer.transform(tokens).select("counts"), "counts")))


def _infer_wide(docs: DataFrame, model: WideTopicModel, text: str) -> DataFrame:
    """Texts are numbered and stored, as their words leave them and come back."""
    numbered = stored(docs.withColumn("_text", F.monotonically_increasing_id()), "texts")
    topics = model.topics_of_texts(tokenize(numbered, text, "terms").select("_text", "terms"), "_text")
    return numbered.join(topics, "_text", "left")


def infer_topics(docs: DataFrame, model: TopicModel | WideTopicModel, text: str = "text") -> DataFrame:
    """Add ``topics`` (weights of at least one percent, scaled to one, by topic) and ``tags``.

    Both are NULL for a document without words, or without any word of the dictionary.
    """
    if isinstance(model, WideTopicModel):
        tags = F.try_element_at(model.tag_map(), S.strongest_topic(F.col("topics")))
        return _infer_wide(docs, model, text).withColumn("tags", tags).select(*docs.columns, "topics", "tags")
    counted = model.vectorizer.transform(tokenize(docs, text))
    weighted = model.lda.transform(counted.withColumnRenamed("counts", model.lda.getFeaturesCol()))
    weights = F.transform(
        vector_to_array(model.lda.getTopicDistributionCol()),
        lambda w, i: F.struct(i.cast("int").alias("topic"), w.alias("weight")),
    )
    kept = F.filter(weights, lambda x: x["weight"] >= P.MIN_TOPIC_WEIGHT)
    known = F.size(F.col("tokens")) > 0
    topics = F.when(known & (F.size(kept) > 0), S.normalise(kept))
    result = weighted.withColumn("topics", topics)
    result = result.withColumn("tags", F.try_element_at(model.tag_map(), S.strongest_topic(F.col("topics"))))
    return result.select(*docs.columns, "topics", "tags")
