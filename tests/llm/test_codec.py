import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lakeprofile.llm import sentencepiece_codec as S
from lakeprofile.llm.catalog import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
PARTS = "the|in|er|▁|  | |\n|\t|é|日本|ﬁ|𝔘|a|ab|aaaa|%%%|2024|<s>|<0x41>|://|----|\x00|====|ThE|​".split("|")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return S.Codec(MODEL)


def texts():
    rng = random.Random(7)
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    letters = ["".join(rng.choice("theinroasd") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    runs = [c * n for c in " a=-▁" for n in (1, 2, 3, 15, 16, 17, 31, 33, 47, 48, 49, 63, 100, 997)]
    return ["", " ", *mixed, *letters, *runs, *(" " * n + "the" for n in range(40))]


def test_ids_and_text_equal_the_library(model, library):
    sample = texts()
    ids, offsets = model.encode(sample)
    decoded = model.decode(ids, offsets)
    for text, a, b, back in zip(sample, offsets, offsets[1:], decoded):
        assert ids[a:b].tolist() == library.encode(text), repr(text)
        assert back == library.decode(ids[a:b].tolist()), repr(text)


def test_decoding_any_ids(model, library):
    rng = random.Random(3)
    lists = [[rng.randint(3, 31_999) for _ in range(rng.randint(0, 9))] for _ in range(2000)]
    lists += [[rng.randint(3, 258) for _ in range(rng.randint(1, 9))] for _ in range(500)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    assert model.decode(np.array([y for x in lists for y in x]), offsets) == [library.decode(x) for x in lists]


def test_long_texts(model, library):
    rng = random.Random(1)
    for text in ("".join(rng.choice("ABCabc012+/") for _ in range(20_000)), "ab" * 20_000, " " * 20_000):
        assert model.encode([text])[0].tolist() == library.encode(text)


def test_forgotten_words_are_encoded_again(model, library, monkeypatch):
    monkeypatch.setattr(S, "CACHED_WORDS", 1)
    for text in ("one two three", "two four", "one"):
        assert model.encode([text])[0].tolist() == library.encode(text)


def test_words_are_cut_as_by_the_pattern_and_listed_once(model):
    sample = [*texts(), "\ud800 x\n\n  y", *(f"a{' ' * n}b\n{' ' * n}" for n in range(44, 130))]
    pattern = re.compile(" {16}(?= {32})| *[^ \n]+| +|\n")
    cut = [pattern.findall(" " + t.replace(S.SPACE, " ")) if t else [] for t in sample]
    distinct, index, per_text = model._words(sample)
    flat = [distinct[i].decode("utf-8", "surrogatepass") for i in index]
    assert [flat[a:b] for a, b in zip(per_text, per_text[1:])] == cut
    assert len(distinct) == len(set(distinct)) < len(flat)


def test_columns(spark):
    rows = [(1, None, "x"), (1, "", "y"), (2, "a  b", "z"), (2, "a  b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = S.encode_decode(df, MODEL)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted((r.doc_id, r.text or "", len(r.ids), r.decoded) for r in out.collect())
    assert got == [(1, "", 0, ""), (1, "", 0, ""), (2, "a  b", 3, "a  b"), (2, "a  b", 3, "a  b")]
    assert S.encode_decode(df.limit(0), MODEL).select(F.size("ids")).collect() == []


def test_a_text_is_encoded_once_for_ids_and_decoded_text(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = S.encode_decode(df, MODEL).select(F.size("ids"), "ids", "decoded")._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan


def test_words_are_forgotten_with_the_task():
    code, model = S.coder(MODEL).func, S.codec(MODEL)
    batches = [pa.array(["one two", None]), pa.array(["two three"])]
    first = next(results := code(iter(batches)))
    assert first.field("decoded").to_pylist() == ["one two", ""] and model.young.known
    assert next(results).field("decoded").to_pylist() == ["two three"]
    assert list(results) == [] and not model.young.known and not model.old.known
    next(stopped := code(iter(batches)))
    stopped.close()  # a task that does not read to its end
    assert not model.young.known
