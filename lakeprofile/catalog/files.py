"""Facts about files. Documents and pages stand in for the files of a lake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.catalog import Entry, sql, table
from lakeprofile.functions import patterns as P
from lakeprofile.functions import scalar as S
from lakeprofile.operators.attributes import dimensions, json_attributes, variables
from lakeprofile.operators.cleaning import text_errors
from lakeprofile.plans.extract import system_facts
from lakeprofile.sources.files import pending

URL_PATH_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
DOC_PATH_SQL = "concat('lake/', source, '/', lang, '/', doc_id, '.txt')"


def page_files(spark, sf) -> DataFrame:
    pages = table(spark, sf, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return pages.select("page_id", path.alias("path"), F.col("html").cast("binary").alias("content"))


def document_files(spark, sf) -> DataFrame:
    path = F.concat(F.lit("lake/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return table(spark, sf, "documents").select(
        "doc_id", path.alias("path"), F.col("text").cast("binary").alias("content"), "text"
    )


def _path_parts(spark, sf):
    path = F.col("path")
    file = S.file_name(path)
    return page_files(spark, sf).select(
        "page_id",
        S.directory(path).alias("directory"),
        file.alias("file"),
        S.extension(file).alias("extension"),
        S.is_hidden(file).alias("hidden"),
    )


PATH_PARTS_SQL = f"""
with f as (select page_id, {URL_PATH_SQL} as path from pages),
     g as (select page_id, regexp_extract(path, '^(.*/)([^/]*)$', 1) as directory,
                  regexp_extract(path, '^(?:.*/)?([^/]*)$', 1) as file from f)
select page_id, directory, file,
       case when contains(file, '.') then string_split(file, '.')[-1] else 'no extension' end as extension,
       starts_with(file, '.') as hidden
from g"""


def _facts(files):
    return system_facts(files).select(
        "path", "file", "extension", "mime_type", "size", "checksum", "route"
    )


def _facts_sql(source: str, path: str, text: str) -> str:
    signatures = " ".join(
        f"when starts_with(head, '{s}') then '{m}'" for s, m in P.SIGNATURES
    )
    return f"""
with f as (select {path} as path, {text} as t from {source}),
     g as (select path, t, regexp_extract(path, '^(?:.*/)?([^/]*)$', 1) as file,
                  hex(substring(t, 1, 8)) as head, lower(ltrim(substring(t, 1, 256))) as s from f),
     h as (select *, case when contains(file, '.') then string_split(file, '.')[-1] else 'no extension' end as extension,
                  case when strlen(t) = 0 then 'inode/x-empty' {signatures}
                       when regexp_matches(t, '{P.NON_TEXT}') then 'application/octet-stream'
                       when starts_with(s, '<?xml') then 'text/xml'
                       when starts_with(s, '<html') or starts_with(s, '<!doctype html') then 'text/html'
                       else 'text/plain' end as mime_type from g)
select path, file, extension, mime_type, strlen(t) as size, sha256(t) as checksum,
       case when contains(lower(extension), 'nc') then 'array'
            when contains(mime_type, 'text') or contains(mime_type, 'csv') or contains(mime_type, 'xml') then 'text'
            else 'other' end as route
from h"""


def _digit_share(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        S.round_half_away(S.digit_share(text), F.lit(9)).alias("head_share"),
        S.round_half_away(S.digit_share(text, None), F.lit(9)).alias("whole_share"),
        S.is_prose(text).alias("prose"),
    )


DIGIT_SHARE_SQL = f"""
with s as (select doc_id, length(regexp_replace(substring(text, 1, 1000), '[^0-9]', '', 'g'))
                          / nullif(length(substring(text, 1, 1000)), 0) as h,
                  length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(length(text), 0) as w from documents)
select doc_id, {sql.rounded('h', 9)} as head_share, {sql.rounded('w', 9)} as whole_share,
       coalesce(h < 0.2, false) as prose
from s"""


def _strip_tags(spark, sf):
    bare = S.strip_tags(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id", F.length(bare).cast("long").alias("n_chars"), F.sha2(bare.cast("binary"), 256).alias("checksum")
    )


STRIP_TAGS_SQL = f"""
with b as (select page_id, regexp_replace(html, '{P.TAG}', '', 'g') as bare from pages)
select page_id, length(bare) as n_chars, sha256(bare) as checksum from b"""


def _number_test(spark, sf):
    """Every order as the fields of a text line, some with endings that only look numeric."""
    def text(c):
        return F.col(c).cast("string")

    fields = F.array(
        text("o_orderkey"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.concat(text("o_custkey"), F.lit("e2")),
        F.concat(F.lit("-."), text("o_custkey")),
        F.concat(text("o_custkey"), F.lit("d")),
        F.concat(F.lit("0x"), text("o_custkey")),
        F.concat(text("o_custkey"), F.lit("_0")),
        "o_orderstatus", "o_orderpriority", F.lit("nan"), F.lit("-Infinity"), F.lit(""),
    )
    orders = table(spark, sf, "orders").select("o_orderkey", F.posexplode(fields).alias("ordinal", "field"))
    return orders.select(
        "o_orderkey",
        "ordinal",
        S.is_number(F.col("field")).alias("numeric"),
        S.round_half_away(S.to_number(F.col("field")), F.lit(6)).alias("value"),
    )


_FIELDS_SQL = [
    "o_orderkey::varchar", "o_totalprice::decimal(18,2)::varchar", "concat(o_custkey, 'e2')", "concat('-.', o_custkey)",
    "concat(o_custkey, 'd')", "concat('0x', o_custkey)", "concat(o_custkey, '_0')", "o_orderstatus", "o_orderpriority",
    "'nan'", "'-Infinity'", "''",
]
NUMBER_TEST_SQL = (
    "with f as ("
    + " union all ".join(
        f"select o_orderkey, {i} as ordinal, {f} as field from orders" for i, f in enumerate(_FIELDS_SQL)
    )
    + f"""), v as (select o_orderkey, ordinal, {sql.is_number('field')} as numeric,
                   case when regexp_matches(field, '{P.FINITE_NUMBER}') then try_cast(field as double) end as x from f)
select o_orderkey, ordinal, numeric, {sql.rounded('x', 6)} as value from v"""
)


def _pending_files(spark, sf):
    """Documents still to be read when those that carry a label are done."""
    listing = document_files(spark, sf).select(
        "doc_id", "path", F.octet_length("content").cast("long").alias("length")
    )
    labels = table(spark, sf, "labels").select("doc_id").distinct()
    done = listing.join(labels, "doc_id").select("path", "length")
    return pending(listing, done, ["path", "length"])


PENDING_SQL = f"""
select doc_id, {DOC_PATH_SQL} as path, strlen(text) as length from documents
where doc_id not in (select doc_id from labels)"""


def _damaged_documents(spark, sf):
    """Documents of toxic label lose their last byte's validity, those of quality 0 their content."""
    labels = table(spark, sf, "labels")
    damaged = F.when(F.col("toxic") == 1, F.concat("content", F.lit(bytearray(b"\xff")))).when(
        F.col("quality") == 0, F.lit(bytearray(b""))
    )
    return document_files(spark, sf).join(labels, "doc_id", "left").select(
        "doc_id", "path", F.coalesce(damaged, "content").alias("content")
    )


def _error_rows(spark, sf):
    return (
        text_errors(_damaged_documents(spark, sf)).filter(F.col("error").isNotNull()).select("doc_id", "path", "error")
    )


ERROR_ROWS_SQL = f"""
select doc_id, {DOC_PATH_SQL} as path, case when toxic = 1 then 'invalid utf-8' else 'empty content' end as error
from documents join labels using (doc_id) where toxic = 1 or quality = 0"""


def _attributes(spark, sf):
    return json_attributes(table(spark, sf, "events"), "props")


ATTRIBUTES_SQL = """
with k as (select props, unnest(json_keys(props)) as name from events)
select 'global' as scope, name,
       case when json_type(props, '$.' || name) in ('UBIGINT', 'BIGINT') then 'BIGINT'
            else json_type(props, '$.' || name) end as type, count(*) as n
from k group by all"""


def _dimensions(spark, sf):
    return dimensions(table(spark, sf, "embeddings"))


DIMENSIONS_SQL = """
select 'embedding' as name, 'array' as type, 'float' as element_type, cast(min(len(embedding)) as integer) as size_min,
       cast(max(len(embedding)) as integer) as size_max, count(embedding) as n
from embeddings"""


def _variables(spark, sf):
    return variables(table(spark, sf, "lineitem"))


_LINEITEM_TYPES = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]
VARIABLES_SQL = " union all ".join(
    f"select '{c}' as name, '{t}' as type, count({c}) as n from lineitem" for c, t in _LINEITEM_TYPES
)

ENTRIES = [
    Entry("path_parts", _path_parts, PATH_PARTS_SQL),
    Entry(
        "system_facts_documents",
        lambda spark, sf: _facts(document_files(spark, sf)),
        _facts_sql("documents", DOC_PATH_SQL, "text"),
    ),
    Entry(
        "system_facts_pages",
        lambda spark, sf: _facts(page_files(spark, sf)),
        _facts_sql("pages", URL_PATH_SQL, "html"),
    ),
    Entry("digit_share", _digit_share, DIGIT_SHARE_SQL),
    Entry("strip_tags", _strip_tags, STRIP_TAGS_SQL),
    Entry("number_test", _number_test, NUMBER_TEST_SQL),
    Entry("pending_files", _pending_files, PENDING_SQL),
    Entry("error_rows", _error_rows, ERROR_ROWS_SQL),
    Entry("attribute_inventory", _attributes, ATTRIBUTES_SQL),
    Entry("array_dimensions", _dimensions, DIMENSIONS_SQL),
    Entry("variable_inventory", _variables, VARIABLES_SQL),
]
