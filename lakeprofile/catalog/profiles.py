"""Profiles of structured tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.catalog import Entry, sql, table
from lakeprofile.functions import scalar as S
from lakeprofile.operators.features import feature_columns
from lakeprofile.operators.profile import profile_columns, with_averages

NUMERIC = {
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    ),
    "orders": ("o_orderkey", "o_custkey", "o_totalprice"),
    "customer": ("c_custkey", "c_nationkey", "c_acctbal"),
    "supplier": ("s_suppkey", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_size", "p_retailprice"),
    "nation": ("n_nationkey", "n_regionkey"),
    "region": ("r_regionkey",),
    "events": ("event_id", "user_id", "value"),
    "documents": ("doc_id", "n_chars"),
}


def flat(profile: DataFrame, *keys: str) -> DataFrame:
    """Profile rows without arrays, the total in cents and the averages of that total.

    The last digits of a sum of doubles depend on the order of the rows, so an average that lies half-way
    between two shown values could be shown either way; all values here are whole cents, and so is the total.
    """
    def extreme(side: str, i: int) -> Column:
        return S.item(F.col(side), i).alias(f"{side}_{i + 1}")

    in_cents = with_averages(profile.withColumn("total", S.round_half_away(F.col("total"), F.lit(2))))
    return in_cents.select(
        *keys, "ordinal", "name", "n_values", "n_rows",
        *[extreme(side, i) for side in ("min", "max") for i in range(3)],
        "total",
        F.col("precision").cast("long").alias("precision"),
        S.round_half_away(F.col("avg_exact"), F.lit(6)).alias("avg_exact"),
        "avg", "avg_compat",
    )


def cells_sql(name: str, columns: tuple[str, ...], values: dict[str, str] | None = None) -> str:
    values = values or {}
    return " union all ".join(
        f"select {i} as ordinal, '{c}' as name, cast({values.get(c, c)} as double) as v from {name}"
        for i, c in enumerate(columns)
    )


def profile_sql(name: str, values: dict[str, str] | None = None) -> str:
    chain = sql.profile(cells_sql(name, NUMERIC[name], values), "", f"select count(*) as n_rows from {name}")
    return f"with {chain} select * from profiled"


def _profile_entry(name: str) -> Entry:
    return Entry(
        f"profile_{name}",
        lambda spark, sf: flat(profile_columns(table(spark, sf, name))),
        profile_sql(name),
    )


# Every seventh line of an order carries the marker of a missing quantity.
MARKED_QUANTITY = "case when l_linenumber = 7 then -999 else l_quantity end"


def _profile_without_sentinels(spark, sf):
    marked = table(spark, sf, "lineitem").withColumn("l_quantity", F.expr(MARKED_QUANTITY).cast("double"))
    return flat(profile_columns(marked, sentinels={"l_quantity": -999.0}))


TINY = ("o_custkey", "o_totalprice")  # profiled as shares of 10 ** 15


def _tiny_values(spark, sf):
    """Values far below one keep their extremes, decimals and average."""
    small = table(spark, sf, "orders").select(*[(F.col(c) / 1e15).alias(c) for c in TINY])
    profile = with_averages(profile_columns(small))
    return profile.select(
        "name", "n_values",
        *[S.item(F.col(side), i).alias(f"{side}_{i + 1}") for side in ("min", "max") for i in range(3)],
        F.col("precision").cast("long").alias("precision"),
        S.round_half_away(F.col("avg") * 1e15, F.lit(1)).alias("avg_of_1e15"),
    )


_TINY_PROFILE = sql.profile(
    " union all ".join(f"select {i} as ordinal, '{c}' as name, {c} / 1e15 as v from orders" for i, c in enumerate(TINY)),
    "",
    "select count(*) as n_rows from orders",
)
TINY_SQL = f"""
with {_TINY_PROFILE}
select name, n_values, min_1, min_2, min_3, max_1, max_2, max_3, precision,
       {sql.rounded(sql.rounded('mean', 'precision') + ' * 1e15', 1)} as avg_of_1e15
from profiled join (select ordinal, avg(v) as mean from cells group by all) using (ordinal)"""


def _column_features(spark, sf):
    features = feature_columns(profile_columns(table(spark, sf, "lineitem")))
    names = S.FEATURE_NAMES
    return features.select("name", *[S.round_half_away(F.col(c), F.lit(6)).alias(c) for c in names])


COLUMN_FEATURES_SQL = f"""
with {sql.profile(cells_sql("lineitem", NUMERIC["lineitem"]), "", "select count(*) as n_rows from lineitem")}
select name, min_1, {sql.rounded('min_2 - min_1', 6)} as min_diff_1, min_2,
       {sql.rounded('min_3 - min_2', 6)} as min_diff_2, min_3,
       max_1, {sql.rounded('max_1 - max_2', 6)} as max_diff_1, max_2,
       {sql.rounded('max_2 - max_3', 6)} as max_diff_2, max_3
from profiled"""

ENTRIES = [_profile_entry(name) for name in NUMERIC] + [
    Entry(
        "profile_without_sentinels",
        _profile_without_sentinels,
        profile_sql("lineitem", {"l_quantity": "case when l_linenumber = 7 then null else l_quantity end"}),
    ),
    Entry("tiny_values_profile", _tiny_values, TINY_SQL),
    Entry("column_features", _column_features, COLUMN_FEATURES_SQL),
]
