import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeprofile.llm import sharding as S


def test_rows_sizes_slots_and_growth(spark):
    rows = [(i, f"text {i % 7}é", "x") for i in range(3000)] + [(5, "again", "x"), (5, "again", "x"), (None, None, "x"), (9, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = S.shards_of(df, 40).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r)
        assert r.law == "key" and r.grown_shard in (r.shard, 40)
    assert set(by_shard) == set(range(40))
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert len({r.shard for r in out if r.doc_id == 5}) == 1
    moved = sum(r.grown_shard == 40 for r in out)
    assert 0.5 < moved / (len(out) / 41) < 1.6
    assert max(map(len, by_shard.values())) < 1.8 * len(out) / 40


def placed(spark, tree, n=4000):
    df = spark.range(n).withColumn("key", F.col("id").cast("string"))
    return {r.id: r.s for r in S.assign(df, F.col("key"), tree, "s").collect()}


def test_movement_stays_in_changed_subtrees(spark):
    weights = [1.0] * 17
    heavier = [3.0 if i == 3 else w for i, w in enumerate(weights)]
    a, b = placed(spark, S.tree(17, weights=weights)), placed(spark, S.tree(17, weights=heavier))
    moves = {(a[k], b[k]) for k in a if a[k] != b[k]}
    assert moves and all(y // 10 == 0 for _, y in moves)  # only into the region of the heavier shard
    assert all(y == 3 for x, y in moves if x // 5 == 0)  # within its rack only into it
    assert Counter(b.values())[3] > 2 * Counter(a.values())[3]


def test_every_later_shard_takes_rows_only_into_itself(spark):
    before = placed(spark, S.tree(12, founding=10))
    for n in (13, 14):
        after = placed(spark, S.tree(n, founding=10))
        assert {after[k] for k in after if after[k] != before[k]} == {n - 1}
        before = after


def test_weights_of_zero_and_bad_arguments(spark):
    assert set(placed(spark, S.tree(3, weights=[0, 1, 0]), 50).values()) == {1}
    with pytest.raises(ValueError):
        S.assign(spark.range(1), F.lit("a"), S.tree(2, weights=[0, 0]), "s")
    with pytest.raises(ValueError):
        S.tree(0)


def test_empty_table(spark):
    assert S.shards_of(spark.createDataFrame([], "doc_id long, text string"), 4).collect() == []
