import math
import random

import pytest
from pyspark.sql import functions as F

from lakeprofile.operators.attributes import dimensions, json_attributes
from lakeprofile.operators.cleaning import clean_features, text_errors, usable_records
from lakeprofile.operators.profile import profile_cells, profile_columns
from lakeprofile.operators.ranks import global_positions
from lakeprofile.operators.sampling import even_sample, holdouts, value_codes
from lakeprofile.operators.scores import macro_scores
from lakeprofile.operators.text import bag_of_words, vocabulary


def test_profile_of_columns_with_few_and_odd_values(spark):
    rows = [(1, 5.0, None), (1, float("nan"), None), (1, float("inf"), None), (2, -0.0, None), (2, 0.0, None)]
    df = spark.createDataFrame(rows, "a int, b double, c double")
    got = {r["name"]: r for r in profile_columns(df).collect()}
    assert got["a"]["min"] == [1.0, 2.0] and got["a"]["max"] == [2.0, 1.0]
    assert got["b"]["min"] == [0.0, 5.0] and got["b"]["n_values"] == 3 and got["b"]["avg_compat"] == 1.0
    assert got["c"]["min"] == [] and got["c"]["avg"] is None and got["c"]["n_rows"] == 5


def test_profile_cells_with_one_key_holding_most_cells(spark):
    rng = random.Random(5)
    cells = [("hot", 0, float(rng.randint(0, 10**6))) for _ in range(30_000)]
    cells += [("hot", 1, 7.0)] * 5000 + [("cold", 0, None), ("cold", 0, 2.0)] + [("empty", 0, None)]
    got = {
        (r["path"], r["ordinal"]): r
        for r in profile_cells(
            spark.createDataFrame(cells, "path string, ordinal int, value double").repartition(7), ["path", "ordinal"]
        ).collect()
    }
    values = sorted({v for p, o, v in cells if (p, o) == ("hot", 0)})
    hot = got["hot", 0]
    assert hot["min"] == values[:3] and hot["max"] == values[::-1][:3] and hot["n_values"] == 30_000
    assert hot["total"] == sum(v for p, o, v in cells if (p, o) == ("hot", 0))
    assert got["hot", 1]["min"] == [7.0] and got["hot", 1]["total"] == 35_000.0
    assert got["cold", 0]["n_values"] == 1 and got["empty", 0]["min"] == [] and got["empty", 0]["n_values"] == 0


def test_positions_need_no_exchange_behind_the_sort(spark):
    df = global_positions(spark.range(1000).withColumnRenamed("id", "k"), ["k"])
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert global_positions(spark.range(0), ["id"]).collect() == []


def test_words_of_a_key_are_counted_where_its_texts_are(spark):
    rows = [(1, "one two two"), (1, "two <b>three"), (None, "one"), (None, "one"), (2, None), (2, "")]
    bag = bag_of_words(spark.createDataFrame(rows, "k long, text string"), "k")
    plan = bag._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k#") == plan.count("Exchange") == 1 and "term#" not in plan.split("hashpartitioning(")[1].split(")")[0]
    assert sorted(((r.k or 0, r.term, r.n) for r in bag.collect())) == [(0, "one", 2), (1, "one", 1), (1, "three", 1), (1, "two", 3)]


def test_global_positions(spark):
    values = list(range(5000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v * 3,) for v in values], "k long").repartition(6)
    got = {r["k"]: (r["position"], r["n"]) for r in global_positions(df, ["k"]).collect()}
    assert got == {v * 3: (v, 5000) for v in values}


def test_even_sample(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [r["k"] for r in even_sample(df, 4, "k").orderBy("k").collect()] == [int(10 / 4.0 * j) for j in range(4)]


@pytest.mark.parametrize("n", [1, 99, 1000])
def test_holdouts_have_the_exact_size(spark, n):
    df = spark.range(n)
    sizes = {r["split"]: r["count"] for r in holdouts(df, "id", 4).groupBy("split").count().collect()}
    assert sizes == {s: math.ceil(0.01 * n) for s in range(4)}


def test_value_codes_follow_first_appearance(spark):
    df = spark.createDataFrame([(1, 7.0), (2, 0.0), (3, 5.0), (4, 7.0)], "id int, v double")
    assert {r["v"]: r["code"] for r in value_codes(df, "v", "id").collect()} == {0.0: 0, 7.0: 1, 5.0: 2}


def test_macro_scores_count_classes_of_both_sides(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "y string, p string")
    row = macro_scores(df, "y", "p").first()
    assert row["accuracy"] == 0.5
    assert row["precision"] == pytest.approx((1 + 0.5 + 0 + 0) / 4)
    assert row["recall"] == pytest.approx((0.5 + 1 + 0 + 0) / 4)


def test_clean_features(spark):
    rows = [(0, ["1", None]), (1, ["x", "1"]), (2, [None, None]), (3, ["nan", None]), (4, ["inf", "-inf"]), (5, [" 1 ", "2"])]
    df = spark.createDataFrame(rows, "id int, f array<string>")
    got = {r["id"]: r["features"] for r in clean_features(df, "f").collect()}
    assert got == {0: [1.0, 0.0], 4: [0.0, float("-inf")], 5: [1.0, 2.0]}


def test_text_errors_drop_nothing(spark):
    rows = [(0, bytearray(b"ok")), (1, bytearray(b"\xff\xfe")), (2, bytearray(b"")), (3, None)]
    got = {r["i"]: r["error"] for r in text_errors(spark.createDataFrame(rows, "i int, content binary")).collect()}
    assert got == {0: None, 1: "invalid utf-8", 2: "empty content", 3: "no content"}


def test_usable_records(spark):
    rows = [
        (0, ["columnar"], [("a",)]), (1, ["columnar"], [("__0__",)]), (2, ["lda"], None), (3, ["columnar"], []),
    ]
    df = spark.createDataFrame(rows, "i int, extractors array<string>, columns array<struct<name:string>>")
    assert sorted(r["i"] for r in usable_records(df).collect()) == [0, 3]


def test_json_attributes(spark):
    rows = [('{"a": 1, "b": {"c": "x", "d": 2.5}}',), ('{"a": "t"}',), ("broken",), (None,)]
    got = {tuple(r) for r in json_attributes(spark.createDataFrame(rows, "j string"), "j").collect()}
    assert got == {
        ("global", "a", "BIGINT", 1), ("global", "a", "STRING", 1), ("global", "b", "OBJECT", 1),
        ("b", "c", "STRING", 1), ("b", "d", "DECIMAL", 1),
    }


def test_dimensions(spark):
    df = spark.createDataFrame([([1, 2],), ([3],)], "v array<int>")
    assert [tuple(r) for r in dimensions(df).collect()] == [("v", "array", "int", 1, 2, 2)]


def test_vocabulary_is_whole_and_ordered(spark):
    docs = spark.createDataFrame([(0, "bbb aaa aaa ccc"), (1, "aaa bbb ddd")], "id int, text string")
    vocab = vocabulary(bag_of_words(docs, "id"))
    assert [(r["term"], r["term_id"], r["n_docs"], r["n"]) for r in vocab.orderBy("term_id").collect()] == [
        ("aaa", 0, 2, 3), ("bbb", 1, 2, 2), ("ccc", 2, 1, 1), ("ddd", 3, 1, 1),
    ]


def test_a_table_is_profiled_in_one_scan_and_not_while_planning(spark):
    rows = [(float(i % 50), i % 7, None if i % 3 else 0.1 * i, float("nan")) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double").repartition(9)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    profile = profile_columns(df)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("ExistingRDD") <= 2 and plan.count("MapInArrow") == 1
    got = {r.name: r for r in profile.collect()}
    assert list(got["a"].min) == [0.0, 1.0, 2.0] and list(got["a"].max) == [49.0, 48.0, 47.0] and got["a"].total == 24500.0
    assert got["b"].n_values == 1000 and list(got["b"].max) == [6.0, 5.0, 4.0]
    assert got["c"].n_values == 334 and abs(got["c"].total - 0.1 * sum(range(0, 1000, 3))) < 1e-6
    assert (got["d"].n_values, got["d"].n_rows, list(got["d"].min), got["d"].total) == (0, 1000, [], None)
    none = {r.name: r for r in profile_columns(df.limit(0)).collect()}
    assert len(none) == 4 and all(r.n_rows == 0 and list(r.max) == [] and r.avg is None for r in none.values())
