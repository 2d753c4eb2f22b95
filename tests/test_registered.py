"""Every registered query that SQL can state, against that SQL at the smallest scale."""

from pathlib import Path

import oracle
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    assert oracle.difference(spark, tables, FOLDER, queries()[name], oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 8


def test_topics_sum_to_one(spark):
    weights = queries()["document_topics"](spark, FOLDER).groupBy("doc_id").sum("weight").collect()
    assert weights and all(abs(r[1] - 1) < 1e-9 for r in weights)
