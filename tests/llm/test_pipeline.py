from pathlib import Path

import pytest
from sentencepiece import SentencePieceProcessor
from test_decontamination import words
from test_jaccard_join import roots, shingles
from test_line_dedup import brute as without_runs

import corpus_pipeline
from lakeprofile.llm import line_dedup
from lakeprofile.llm.catalog import TOKENIZERS

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


def hit_words(text, windows):
    own = words(text)
    hit = set()
    for size in {len(w) for w in windows}:
        for p in range(len(own) - size + 1):
            if tuple(own[p : p + size]) in windows:
                hit |= set(range(p, p + size))
    return len(hit), len(own)


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    junk = spark.createDataFrame([(10_001, "12 34 --", "en", "x", 8), (10_002, None, None, None, None)], docs.schema)
    docs.unionByName(junk).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    cut = without_runs(rows, line_dedup.LEAST_WORDS)
    left = sorted((i, cut[i]) for i, t in rows if cut[i] or not t)
    sets = [shingles(t, 5) for _, t in left]
    pairs = [(i, j) for i in range(len(left)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    first = {}
    for (i, _), root in zip(left, roots(len(left), pairs)):
        first[root] = min(first.get(root, i), i)
    single = [(i, t) for i, t in left if i in set(first.values())]
    windows = set()
    for item in benchmark.collect():
        theirs = words(item.text)
        size = min(13, len(theirs))
        windows |= {tuple(theirs[p : p + size]) for p in range(len(theirs) - size + 1) if theirs}
    model = SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    expected = {}
    for i, text in single:
        hit, n = hit_words(text, windows)
        if not (hit and 20 * hit >= n):
            expected[i] = model.encode(text)
    assert len(expected) < len(single) < len(left) < len(rows)
    assert {i: r.ids for i, r in result.items()} == expected
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in result.values())


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(5)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_the_encoder_takes_small_batches(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(5)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER)
        most = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
        assert most <= (1 << 20 if name == "SentencePiece encoding" else 8 << 20)


def test_line_dedup_cuts_a_text_once(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = corpus_pipeline.delete_lines(spark, docs, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [cut(") == 1, plan


def test_all_stages_take_small_batches(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(5)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20
