from collections import Counter

import numpy as np
import pytest
import tiktoken

from lakeprofile.llm import token_counts as T
from lakeprofile.llm.catalog import CUT, SEPARATOR, TOKENIZERS


def documents(ids, separator):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == separator:
            out.append((start, i - start))
            start = i + 1
    return out + ([(start, len(ids) - start)] if start < len(ids) else [])


@pytest.mark.parametrize(("block", "group", "kind"), [(7, 3, "<u2"), (64, 2, "<u4"), (5000, 256, "<u2"), (1, 40, "<u2")])
def test_binary_files(spark, tmp_path, block, group, kind):
    rng = np.random.default_rng(block)
    expected = {}
    for i, n in enumerate([0, 1, 7, 300, 900]):
        ids = rng.integers(0, 9, n)
        if i == 4:
            ids[100:700] = 5  # a document over many blocks
        ids.astype(kind).tofile(tmp_path / f"{i}.bin")
        expected[i] = documents(ids.tolist(), 3)
    (tmp_path / "4.bin").open("ab").write(b"\x01")  # a torn id
    size = np.dtype(kind).itemsize
    blocks = T.read_token_files(spark, str(tmp_path), size, block)
    found = {i: [] for i in expected}
    for r in T.count_tokens(blocks, 3, size, group).orderBy("file", "ordinal").collect():
        assert r.ordinal == len(found[int(r.file[-5])])
        found[int(r.file[-5])].append((r.first, r.n_tokens))
    assert found == expected


def test_documents_through_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_TOKENS", 50)
    rows = [(i, f"some text {i} " * (i % 9), "x") for i in range(60)] + [(1, None, "x"), (None, "nobody", "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    import base64

    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("test", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
    path = str(tmp_path / "blocks")
    T.write_token_blocks(df, path, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", CUT, SEPARATOR)
    found = Counter((r.doc_id, r.n_tokens) for r in T.counts_by_document(spark, path, SEPARATOR).collect())
    assert found == Counter((i, len(encoding.encode_ordinary(t or ""))) for i, t, _ in rows)


def test_empty_and_null_blocks(spark):
    df = spark.createDataFrame([("f", 0, None), ("f", 1, b"\x03\x00\x01\x00")], "file string, block long, tokens binary")
    assert [tuple(r) for r in T.count_tokens(df, 3).orderBy("ordinal").collect()] == [("f", 0, 0, 0), ("f", 1, 1, 1)]
    assert T.count_tokens(df.limit(0), 3).collect() == []
