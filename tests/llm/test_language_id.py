import zlib
from pathlib import Path

import pytest

from lakeprofile.llm import language_id as L
from lakeprofile.llm.catalog import language_identification

FOLDER = "/root/testdata/sf0.01"


def brute_profile(text, size):
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    counts = {}
    padded = " " + " ".join(words) + " " if words else ""
    for n in L.ORDERS:
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if gram == " " or (n == 3 and gram[1] == " "):
                continue
            counts[gram] = counts.get(gram, 0) + 1
    code = lambda g: (len(g) << 60) + sum((0 if c == " " else ord(c)) << (20 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))][:size]


@pytest.mark.parametrize("text", ["", "...", "A.", "Der Hund, die Katze und  der HUND!", "ñandú ñ 日本語 x2y"])
def test_profiles_equal_brute_force(text):
    assert L.profile(text, 40).tolist() == brute_profile(text, 40)


def test_out_of_place_distance():
    model = L.Profiles({"a": [5, 6, 7], "b": [7, 6]}, 3)
    assert model.distances(L.np.array([6, 9, 7])).tolist() == [1 + 3 + 0, 1 + 3 + 2]


def test_ties_and_odd_texts(spark):
    rows = [("de", "der die das"), ("aa", "der die das"), (None, "x"), ("fr", None)]
    profiles = L.learn(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string"))
    assert profiles.languages == ["aa", "de"]
    df = spark.createDataFrame([(1, None, 1), (1, "123", 2), (2, "die das der", 3)], "doc_id long, text string, language int")
    got = sorted((r.doc_id, r.text or "", r.language.lang_pred, r.language.score > 0) for r in L.predict(df, profiles).collect())
    assert got == [(1, "", "und", False), (1, "123", "und", False), (2, "die das der", "aa", True)]
    nothing = L.learn(spark.createDataFrame([], "doc_id long, lang string, text string"))
    assert {r.language.lang_pred for r in L.predict(df, nothing).collect()} == {"und"}
    assert L.predict(df.limit(0), profiles).collect() == []


def test_a_sample_is_bounded(spark):
    rows = [(i, "en" if i % 2 else "de", "the" if i % 2 else "der") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert L.learn(df, sample_per_language=20).languages == ["de", "en"]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language_identification(spark, FOLDER).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
