"""The registered queries: name -> (Spark query, SQL that any engine can check it with, or None)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from lakeprofile.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    name: str
    query: Query
    sql: str | None


# Tables with long texts, and the key by which few large splits are spread over the cores.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", TEXT_KEYS.get(name))


def entries() -> list[Entry]:
    from lakeprofile.catalog import crawls, files, models, pipelines, profiles, tables, text, tree

    found = [e for m in (profiles, files, tables, text, tree, models, pipelines, crawls) for e in m.ENTRIES]
    assert len({e.name for e in found}) == len(found)
    return found
