"""Table discovery on texts rendered from the orders and line items, and on the documents as they are.

Every run of a hundred order keys becomes one text: a document's text as preamble, a name row, a row of units,
one row per order and three closing lines. The delimiter changes from text to text. What discovery must find
follows directly from the orders, which is what the SQL states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.catalog import Entry, sql, table
from lakeprofile.catalog.profiles import flat
from lakeprofile.functions import patterns as P
from lakeprofile.functions import scalar as S
from lakeprofile.operators.discover import detected_dialect, find_tables, table_columns, table_headers
from lakeprofile.operators.lines import find_tables_in_lines
from lakeprofile.sources.stores import stored

KEYS_PER_TEXT = 100
LAST_PREAMBLE_LINE = "Report of orders"
CLOSING = ("", "", "end of report", "checked by hand", "printed on paper")
NAMES = ("OrderKey", "CustKey", "Status", "TotalPrice", "Priority", "OrderDate")
UNITS = ("key", "key", "code", "USD", "class", "day")


def _join_fields(fields: list[Column], delimiter: Column) -> Column:
    return F.concat(*[part for f in fields for part in (f, delimiter)][:-1])


def rendered_orders(spark, sf) -> DataFrame:
    """(file_id, text): at most a hundred orders each."""
    delimiter = F.element_at(
        F.array(*[F.lit(d) for d, _ in P.DIALECTS]), (F.pmod("file_id", F.lit(3)) + 1).cast("int")
    )
    orders = table(spark, sf, "orders").withColumn(
        "file_id", F.floor(F.col("o_orderkey") / KEYS_PER_TEXT).cast("long")
    )
    fields = [
        F.col("o_orderkey").cast("string"),
        F.col("o_custkey").cast("string"),
        F.col("o_orderstatus"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.replace("o_orderpriority", F.lit(" "), F.lit("_")),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
    ]
    bodies = (
        orders.withColumn("line", _join_fields(fields, delimiter))
        .groupBy("file_id")
        .agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))).alias("rows"))
        .withColumn("body", F.array_join(F.transform("rows", lambda x: x["line"]), "\n"))
    )
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("note"))
    pieces = [
        "note",
        F.lit(LAST_PREAMBLE_LINE),
        _join_fields([F.lit(n) for n in NAMES], delimiter),
        _join_fields([F.lit(u) for u in UNITS], delimiter),
        "body",
        *[F.lit(c) for c in CLOSING],
    ]
    return bodies.join(documents, "file_id", "left").select("file_id", F.concat_ws("\n", *pieces).alias("text"))


_RENDERED_SQL = f"""
files as (
  select *, floor(o_orderkey / {KEYS_PER_TEXT})::bigint as file_id from orders),
counted as (
  select file_id, count(*) - 2 as n_rows,
         case file_id % 3 when 0 then ',' when 1 then chr(9) else ' ' end as delimiter
  from files group by all)"""


def _discover(spark, sf):
    found = find_tables(rendered_orders(spark, sf))
    return found.select(
        "file_id",
        "found.delimiter",
        F.col("found.width").alias("width"),
        "found.n_rows",
        F.array_join("found.types", "|").alias("types"),
        F.array_join("found.names", "|").alias("names"),
    )


DISCOVER_SQL = f"""
with {_RENDERED_SQL}
select file_id, delimiter, 6 as width, n_rows, 'num|num|str|num|str|str' as types,
       '{"|".join(NAMES).lower()}' as names
from counted"""


def _table_profile(spark, sf):
    return flat(table_columns(find_tables(rendered_orders(spark, sf)), "file_id"), "file_id")


_NUMERIC_CELLS = " union all ".join(
    f"select file_id, {i} as ordinal, '{NAMES[i].lower()}' as name, cast({c} as double) as v from files"
    for i, c in ((0, "o_orderkey"), (1, "o_custkey"), (3, "o_totalprice"))
)
TABLE_PROFILE_SQL = f"""
with {_RENDERED_SQL},
{sql.profile(_NUMERIC_CELLS, "file_id", "select file_id, n_rows from counted")}
select * from profiled"""


def _as_lines(files: DataFrame) -> DataFrame:
    """Numbered lines, stored once: all later passes read the same numbers."""
    lines = files.select(
        F.col("file_id").alias("path"), F.posexplode(F.split("text", P.EOL, -1)).alias("position", "line")
    )
    return stored(lines, "lines")


def _table_profile_lines(spark, sf):
    found = find_tables_in_lines(_as_lines(rendered_orders(spark, sf)))
    return flat(found.columns.withColumnRenamed("path", "file_id"), "file_id")


def _discover_lines(spark, sf):
    found = find_tables_in_lines(_as_lines(rendered_orders(spark, sf))).tables
    return found.select(
        F.col("path").alias("file_id"),
        "delimiter",
        "width",
        "n_rows",
        F.array_join("names", "|").alias("names"),
        F.sha2(F.col("preamble").cast("binary"), 256).alias("preamble"),
    )


_PREAMBLE = (
    f"sha256(right(concat_ws(chr(10), d.text, '{LAST_PREAMBLE_LINE}'), {P.PREAMBLE_CHARS}))"
)
DISCOVER_LINES_SQL = f"""
with {_RENDERED_SQL}
select file_id, delimiter, 6 as width, n_rows, '{"|".join(NAMES).lower()}' as names, {_PREAMBLE} as preamble
from counted left join documents d on doc_id = file_id"""


def _table_headers(spark, sf):
    return table_headers(find_tables(rendered_orders(spark, sf)), "file_id")


TABLE_HEADERS_SQL = f"""
with {_RENDERED_SQL},
h as (select unnest({sorted({n.lower() for n in NAMES + UNITS})!r}) as header)
select file_id, header from counted, h"""


def _table_preamble(spark, sf):
    preamble = F.col("found.preamble")
    return find_tables(rendered_orders(spark, sf)).select(
        "file_id",
        F.length(preamble).cast("long").alias("n_chars"),
        F.sha2(preamble.cast("binary"), 256).alias("preamble"),
    )


TABLE_PREAMBLE_SQL = f"""
with {_RENDERED_SQL}
select file_id,
       length(right(concat_ws(chr(10), d.text, '{LAST_PREAMBLE_LINE}'), {P.PREAMBLE_CHARS})) as n_chars,
       {_PREAMBLE} as preamble
from counted left join documents d on doc_id = file_id"""


# ---- verdicts only -----------------------------------------------------------------------------------

def _detect_dialect(spark, sf):
    return rendered_orders(spark, sf).select("file_id", detected_dialect(F.col("text")).alias("delimiter"))


DETECT_DIALECT_SQL = f"with {_RENDERED_SQL} select file_id, delimiter from counted"


def _classify_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", detected_dialect(F.col("text")).alias("delimiter"))


def _rows_sql(delimiter: str, pattern: str, keep_blank: bool) -> str:
    fields = f"list_transform(regexp_split_to_array(line, '{pattern}'), lambda x: {sql.strip('x')})"
    if not keep_blank:
        fields = f"list_filter({fields}, lambda x: x <> '')"
    return f"list_transform(probe, lambda line: {fields})"


def _accepted_sql(rows: str) -> str:
    return (
        f"(len(list_distinct(list_transform({rows}, lambda r: len(r)))) = 1 and "
        f"len(list_filter({rows}, lambda r: len(list_filter(r, lambda f: {sql.is_number('f')})) = 0)) = 0)"
    )


CLASSIFY_DOCUMENTS_SQL = f"""
with l as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '{P.EOL}'),
                                                     lambda x: {sql.strip('x')}), lambda x: x <> '') as lines
           from documents),
     p as (select doc_id, len(lines) as n, lines[len(lines) - 9 : len(lines) - 5] as probe from l),
     r as (select doc_id, n, {_rows_sql(',', ',', True)} as c, {_rows_sql('t', chr(92) + 't', False)} as t,
                  {_rows_sql(' ', '[' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'v' + chr(92) + 'f' + chr(92) + 'r ]', False)} as s from p)
select doc_id, case when n < 10 then null when {_accepted_sql('c')} then ',' when {_accepted_sql('t')} then chr(9)
                    when {_accepted_sql('s')} then ' ' end as delimiter
from r"""


# ---- sentinels ---------------------------------------------------------------------------------------

ITEM_NAMES = ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
ORDER_KEYS_PER_TEXT = 50


def rendered_items(spark, sf) -> DataFrame:
    """(file_id, text): the line items of fifty orders each, every seventh line with -999 for its quantity."""
    items = table(spark, sf, "lineitem").withColumn(
        "file_id", F.floor(F.col("l_orderkey") / ORDER_KEYS_PER_TEXT).cast("long")
    )
    quantity = F.expr("case when l_linenumber = 7 then -999 else l_quantity end")
    line = F.concat_ws(
        ",",
        F.col("l_orderkey").cast("string"),
        F.col("l_partkey").cast("string"),
        quantity.cast("decimal(18,2)").cast("string"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        "l_returnflag",
    )
    bodies = (
        items.withColumn("line", line)
        .groupBy("file_id")
        .agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "line"))).alias("rows"))
        .withColumn("body", F.array_join(F.transform("rows", lambda x: x["line"]), "\n"))
    )
    pieces = [F.lit(",".join(ITEM_NAMES)), "body", *[F.lit(c) for c in CLOSING]]
    return bodies.select("file_id", F.concat_ws("\n", *pieces).alias("text"))


def _table_without_sentinels(spark, sf):
    files = rendered_items(spark, sf).withColumn(
        "sentinels", F.array(*[F.lit(s).cast("double") for s in (None, None, -999, 0, None)])
    )
    return flat(table_columns(find_tables(files, sentinels="sentinels"), "file_id"), "file_id")


_ITEM_CELLS = " union all ".join(
    f"select file_id, {i} as ordinal, '{ITEM_NAMES[i]}' as name, cast({c} as double) as v from files"
    for i, c in (
        (0, "l_orderkey"), (1, "l_partkey"), (2, "case when l_linenumber = 7 then null else l_quantity end"),
        (3, "l_extendedprice"),
    )
)
TABLE_WITHOUT_SENTINELS_SQL = f"""
with files as (select *, floor(l_orderkey / {ORDER_KEYS_PER_TEXT})::bigint as file_id from lineitem),
{sql.profile(_ITEM_CELLS, "file_id", "select file_id, count(*) - 2 as n_rows from files group by all having count(*) >= 7")}
select * from profiled"""

ENTRIES = [
    Entry("discover_tables", _discover, DISCOVER_SQL),
    Entry("table_profile", _table_profile, TABLE_PROFILE_SQL),
    Entry("table_profile_lines", _table_profile_lines, TABLE_PROFILE_SQL),
    Entry("discover_tables_lines", _discover_lines, DISCOVER_LINES_SQL),
    Entry("table_headers", _table_headers, TABLE_HEADERS_SQL),
    Entry("table_preamble", _table_preamble, TABLE_PREAMBLE_SQL),
    Entry("detect_dialect", _detect_dialect, DETECT_DIALECT_SQL),
    Entry("classify_documents", _classify_documents, CLASSIFY_DOCUMENTS_SQL),
    Entry("table_without_sentinels", _table_without_sentinels, TABLE_WITHOUT_SENTINELS_SQL),
]
