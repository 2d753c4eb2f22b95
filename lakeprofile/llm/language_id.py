"""Language identification by rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import chunks

ORDERS = (1, 2, 3)
PROFILE = 300  # n-grams of a profile, of a language as of a document
SAMPLE_PER_LANGUAGE = 4_000  # labelled rows per language that the profiles are made from, about
UNKNOWN = "und"
RESULT = "lang_pred string, score double"

_BITS = 20  # of a letter; the order of an n-gram stands above three of them
_POINTS = 0x110000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point of the small form of each letter, 0 for everything that is no letter."""
    table = np.zeros(_POINTS, dtype=np.int64)
    for point in range(_POINTS):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            table[point] = ord(char.lower()[0])
    return table


def grams(text: str) -> np.ndarray:
    """All n-grams of a text, as numbers: within words, words bounded by one blank, single blanks left out."""
    letters = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    gap = letters == 0
    letters = letters[~gap | ~np.append(False, gap[:-1])]  # one gap between words
    found = []
    for order in ORDERS:
        if len(letters) < order:
            continue
        code = np.full(len(letters) - order + 1, order, dtype=np.int64)
        for i in range(order):
            code = code << _BITS | letters[i : i + len(code)]
        inner = letters[order // 2 : order // 2 + len(code)] > 0 if order != 2 else np.ones(len(code), dtype=bool)
        code += np.int64(order << (3 * _BITS)) - np.int64(order << (order * _BITS))
        found.append(code[inner])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first; of equal counts the smaller code first."""
    return codes[np.lexsort((codes, -counts))[:size]]


def profile(text: str, size: int = PROFILE) -> np.ndarray:
    codes, counts = np.unique(grams(text), return_counts=True)
    return ranked(codes, counts, size)


class Profiles:
    """Language profiles in the form of one sorted table of n-grams with their rank in each language."""

    def __init__(self, ranks: dict[str, list[int]], size: int):
        self.languages = sorted(ranks)
        self.size = size
        self.codes = np.unique(np.array([c for r in ranks.values() for c in r], dtype=np.int64))
        self.places = np.full((len(self.codes) + 1, len(self.languages)), -1, dtype=np.int64)
        for column, language in enumerate(self.languages):
            own = np.array(ranks[language], dtype=np.int64)
            self.places[np.searchsorted(self.codes, own), column] = np.arange(len(own))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language; an n-gram that a language lacks counts the profile size."""
        if not len(self.codes):
            return np.zeros(len(self.languages))
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        places = self.places[at]
        out = np.abs(places - np.arange(len(own))[:, None])
        return np.where(places < 0, self.size, out).sum(axis=0)

    def predict(self, text: str) -> tuple[str, float]:
        own = profile(text, self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        distances = self.distances(own)
        best = int(np.argmin(distances))  # of equal distances the first language in order
        return self.languages[best], float(1 - distances[best] / (self.size * len(own)))


def learn(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    size: int = PROFILE,
    sample_per_language: int | None = SAMPLE_PER_LANGUAGE,
) -> Profiles:
    """Profiles of all languages among the labelled rows.

    N-grams are counted in the tasks. Of a language with more rows than ``sample_per_language`` a sample of about
    that many rows is taken by a hash of their ids; None takes all. Rows without text or language teach nothing.
    The driver receives ``size`` n-grams per language.
    """
    rows = labelled.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")
    ).where("lang is not null and text is not null")
    if sample_per_language is not None:
        share = rows.groupBy("lang").agg(F.least(F.lit(1.0), sample_per_language / F.count(F.lit(1))).alias("share"))
        kept = {r["lang"]: r["share"] for r in share.collect()}
        if any(s < 1 for s in kept.values()):
            draw = F.pmod(F.xxhash64("id", F.lit("language profile")), F.lit(1 << 30)) / float(1 << 30)
            limits = F.create_map(*(F.lit(x) for pair in kept.items() for x in pair))
            rows = rows.where(draw < limits[F.col("lang")])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            by_language: dict[str, list[str]] = {}
            for language, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                by_language.setdefault(language, []).append(text)
            for language, texts in by_language.items():
                for run in chunks(texts):
                    codes, counts = np.unique(np.concatenate([grams(t) for t in run]), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [language] * len(codes), "code": codes, "n": counts})

    from pyspark.sql import Window as W

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint")
    totals = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # The n-grams of a language are spread over parts first, so no task ranks all of them.
    order = [F.desc("n"), F.asc("code")]
    part = F.pmod(F.xxhash64("code"), F.lit(64))
    parts = totals.withColumn("place", F.row_number().over(W.partitionBy("lang", part).orderBy(*order)))
    first = parts.where(F.col("place") <= size).withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    ranks: dict[str, list[int]] = {}
    for row in first.where(F.col("place") <= size).orderBy("lang", "place").collect():
        ranks.setdefault(row["lang"], []).append(row["code"])
    return Profiles(ranks, size)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with one more column ``language`` = (lang_pred, score), which replaces one of that name.

    The language of the nearest profile and 1 - distance / largest possible distance. ``und`` and 0 if the text is
    null, empty or without letters, or if nothing was learned. Equal distances go to the first language in order.
    Whole texts are read; rows stay where they are, repeated ones too, and no other column is touched.
    """
    from pyspark.sql.functions import arrow_udf

    broadcast = docs.sparkSession.sparkContext.broadcast(profiles)  # size x languages numbers
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @arrow_udf(RESULT)
    def language(texts: pa.Array) -> pa.Array:
        model = broadcast.value
        found = [model.predict(t) for run in chunks(texts.to_pylist()) for t in run]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], fields=list(kind)
        )

    return docs.withColumn(out_col, language(F.col(text_col)))
