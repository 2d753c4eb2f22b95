"""Whole jobs over the documents, the rendered tables and the pages as one lake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.catalog import Entry, sql, table
from lakeprofile.catalog.files import DOC_PATH_SQL, URL_PATH_SQL, document_files, page_files
from lakeprofile.catalog.models import vectors
from lakeprofile.catalog.tables import (
    CLASSIFY_DOCUMENTS_SQL,
    ITEM_NAMES,
    KEYS_PER_TEXT,
    LAST_PREAMBLE_LINE,
    NAMES,
    ORDER_KEYS_PER_TEXT,
    TABLE_PROFILE_SQL,
    rendered_items,
    rendered_orders,
)
from lakeprofile.functions import patterns as P
from lakeprofile.functions import scalar as S
from lakeprofile.functions.rows import explode_computed
from lakeprofile.operators.discover import find_tables, table_columns
from lakeprofile.operators.features import column_features
from lakeprofile.operators.scores import macro_scores, validation_report
from lakeprofile.plans import train
from lakeprofile.plans.extract import classify_files, extract
from lakeprofile.plans.refine import refine
from lakeprofile.plans.sentinels import infer_sentinels
from lakeprofile.plans.topics import infer_topics, train_topics
from lakeprofile.session import ensure_checkpoint_dir
from lakeprofile.sources.metadata import RECORD_SCHEMA, records_to_json, training_columns

TOPICS = 8


def order_files(spark, sf) -> DataFrame:
    path = F.concat(F.lit("lake/orders/"), F.col("file_id"), F.lit(".csv"))
    return rendered_orders(spark, sf).select(path.alias("path"), F.col("text").cast("binary").alias("content"))


def lake(spark, sf) -> DataFrame:
    """(path, content) of documents, rendered orders and pages."""
    parts = [document_files(spark, sf), order_files(spark, sf), page_files(spark, sf)]
    files = [p.select("path", "content") for p in parts]
    return files[0].unionByName(files[1]).unionByName(files[2])


def _model(spark, sf):
    return train_topics(table(spark, sf, "documents"), TOPICS)


def _classify(spark, sf):
    files = document_files(spark, sf).select("path", "content").unionByName(order_files(spark, sf))
    return classify_files(files).select(
        "path", "route", "delimiter", F.array_join("extractors", "|").alias("extractors")
    )


CLASSIFY_SQL = f"""
with verdicts as ({CLASSIFY_DOCUMENTS_SQL}),
d as (select concat('lake/', source, '/', lang, '/', doc_id, '.txt') as path, delimiter,
             length(regexp_replace(substring(text, 1, 1000), '[^0-9]', '', 'g')) / length(substring(text, 1, 1000)) < 0.2
               and len(regexp_extract_all(regexp_replace(text, '<[^\\r\\n]+>', '', 'g'), '[a-zA-Z]{{3,}}')) > 0 as prose
      from documents join verdicts using (doc_id)),
files as (select distinct floor(o_orderkey / 100)::bigint as file_id from orders)
select path, 'text' as route, delimiter,
       case when delimiter is not null then 'columnar' when prose then 'lda' else '' end as extractors from d
union all
select concat('lake/orders/', file_id, '.csv'), 'text',
       case file_id % 3 when 0 then ',' when 1 then chr(9) else ' ' end, 'columnar' from files"""


def _training_columns(spark, sf):
    files = rendered_orders(spark, sf).withColumn("path", F.concat(F.lit("lake/orders/"), "file_id", F.lit(".csv")))
    rows = training_columns(table_columns(find_tables(files), "path"))
    features = [S.round_half_away(F.col(f), F.lit(6)).alias(f) for f in S.FEATURE_NAMES]
    return rows.select("path", "file", "column", *features, F.col("null").cast("double").alias("null"))


TRAINING_COLUMNS_SQL = f"""
with p as ({TABLE_PROFILE_SQL})
select 'lake/orders/' as path, concat(file_id, '.csv') as file, name as column,
       min_1, {sql.rounded('min_2 - min_1', 6)} as min_diff_1, min_2, {sql.rounded('min_3 - min_2', 6)} as min_diff_2, min_3,
       max_1, {sql.rounded('max_1 - max_2', 6)} as max_diff_1, max_2, {sql.rounded('max_2 - max_3', 6)} as max_diff_2, max_3,
       cast(null as double) as "null"
from p"""


def _extract(spark, sf):
    """The records of the lake, with topics, as they are written."""
    return records_to_json(extract(lake(spark, sf), _model(spark, sf)))


def _extract_facts(spark, sf):
    """The records of the rendered tables without topics."""
    records = extract(order_files(spark, sf))
    return records.select(
        "path", "size", "checksum", "delimiter", "n_rows",
        F.array_join("extractors", "|").alias("extractors"),
        F.array_join(F.transform("columns", lambda c: c["name"]), "|").alias("names"),
        F.size("headers").cast("long").alias("n_headers"),
    )


def _rendered_sql() -> str:
    """The rendered text itself, stated in SQL."""
    def line(fields, d="delimiter"):
        return f" || {d} || ".join(fields)

    fields = (
        "o_orderkey::varchar", "o_custkey::varchar", "o_orderstatus", "o_totalprice::decimal(18,2)::varchar",
        "replace(o_orderpriority, ' ', '_')", "strftime(o_orderdate, '%Y-%m-%d')",
    )
    names = line([f"'{n}'" for n in NAMES])
    units = line([f"'{u}'" for u in ("key", "key", "code", "USD", "class", "day")])
    return f"""
rows_ as (select *, floor(o_orderkey / 100)::bigint as file_id from orders),
keyed as (select *, case file_id % 3 when 0 then ',' when 1 then chr(9) else ' ' end as delimiter from rows_),
bodies as (select file_id, delimiter, count(*) - 2 as n_rows,
                  string_agg({line(fields)}, chr(10) order by o_orderkey) as body from keyed group by all),
texts as (select file_id, delimiter, n_rows,
                 concat_ws(chr(10), d.text, 'Report of orders', {names}, {units}, body, '', '', 'end of report',
                           'checked by hand', 'printed on paper') as text
          from bodies left join documents d on d.doc_id = file_id)"""


EXTRACT_FACTS_SQL = f"""
with {_rendered_sql()}
select concat('lake/orders/', file_id, '.csv') as path, strlen(text) as size, sha256(text) as checksum, delimiter,
       n_rows, 'columnar' as extractors, 'orderkey|custkey|totalprice' as names, 11::bigint as n_headers
from texts"""


def _topics(spark, sf):
    docs = infer_topics(table(spark, sf, "documents").select("doc_id", "text"), _model(spark, sf))
    return explode_computed(docs, "topics", "t", "doc_id").select("doc_id", "t.topic", "t.weight")


def _tags(spark, sf):
    docs = infer_topics(table(spark, sf, "documents").select("doc_id", "text"), _model(spark, sf))
    return docs.filter(F.col("tags").isNotNull()).select("doc_id", F.array_join("tags", " ").alias("tags"))


def _refine(spark, sf):
    """Rendered tables have no topics of their own here and take those of the nearest documents or pages."""
    ensure_checkpoint_dir(spark)
    model = _model(spark, sf)
    records = extract(lake(spark, sf), model, lda_preamble=False).checkpoint()
    refined = refine(records, topic_model=model)
    return refined.select(
        "path", "topics_source", F.size("topics").alias("n_topics"), F.array_join("tags", " ").alias("tags")
    )


def named_columns(spark, sf) -> DataFrame:
    """(id, name, features) of all columns found in the rendered orders and line items."""
    found = [table_columns(find_tables(f(spark, sf)), "file_id") for f in (rendered_orders, rendered_items)]
    both = column_features(found[0].unionByName(found[1]))
    return both.select(F.concat_ws("/", "name", "file_id").alias("id"), "name", "features")


def _checkpointed_columns(spark, sf) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return named_columns(spark, sf).checkpoint()


def _column_names(spark, sf):
    """Names of the columns of every other file, learned from the files between."""
    rows = _checkpointed_columns(spark, sf)
    half = F.pmod(F.crc32(F.substring_index("id", "/", -1).cast("binary")), F.lit(2))
    return train.predict_names(rows.where(half == 1), train.train_names(rows.where(half == 0))).select("id", "name", "predicted_name", "certainty")


def _column_name_scores(spark, sf):
    rows = _checkpointed_columns(spark, sf)
    return macro_scores(train.name_holdout_predictions(rows, "id"), "name", "predicted_name")


def _column_name_report(spark, sf):
    """Scores of all hold-out predictions and of those that are nearly certain."""
    predictions = train.name_holdout_predictions(_checkpointed_columns(spark, sf), "id")
    return validation_report(predictions, "name", "predicted_name", train.NAME_CERTAINTY)


def _column_name_search(spark, sf):
    rows = _checkpointed_columns(spark, sf)
    search = train.search_names(rows)
    settings = [
        ({param.name: int(value) for param, value in setting.items()}, float(accuracy))
        for setting, accuracy in zip(search.getEstimatorParamMaps(), search.avgMetrics)
    ]
    rows = [(s["numTrees"], s["maxDepth"], accuracy) for s, accuracy in settings]
    return spark.createDataFrame(rows, "num_trees int, max_depth int, accuracy double")


def _sentinels(spark, sf):
    """Sentinels of the columns of every other table of line items, learned from the tables between; labels follow from
    what was written into them."""
    ensure_checkpoint_dir(spark)
    columns = table_columns(find_tables(rendered_items(spark, sf)), "file_id").checkpoint()
    marked = F.col("min")[0] == -999
    taught, judged = columns.where("file_id % 2 = 0"), columns.where("file_id % 2 = 1")
    training = column_features(taught).select(
        F.concat_ws("/", "file_id", "ordinal").alias("tid"), "features", F.when(marked, -999).otherwise(0).alias("label")
    )
    return infer_sentinels(judged.withColumn("path", F.col("file_id").cast("string")), training)


SENTINELS_SQL = """
with f as (select *, floor(l_orderkey / 50)::bigint as file_id from lineitem),
t as (select file_id, bool_or(l_linenumber = 7) as marked from f group by all having count(*) >= 7)
select file_id::varchar as path, ordinal::int as ordinal,
       case when ordinal = 2 and marked then -999.0::double end as sentinel
from t, range(4) r(ordinal) where file_id % 2 = 1"""


def _project(spark, sf):
    return train.project(vectors(spark, sf)).select("id", "label", "pc_1", "pc_2")


def _projection_moments(spark, sf):
    """What any projection on principal components has: means of zero, no correlation, falling spread."""
    a, b = F.col("pc_1"), F.col("pc_2")
    moments = train.project(vectors(spark, sf)).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.abs(F.avg(c)), 6).alias(f"mean_{i}") for i, c in ((1, a), (2, b))],
        F.round(F.abs(F.corr(a, b)), 6).alias("correlation"),
        (F.var_pop(a) >= F.var_pop(b)).alias("falling"),
    )
    return moments


PROJECTION_SQL = """
select count(*) as n, 0.0::double as mean_1, 0.0::double as mean_2, 0.0::double as correlation, true as falling
from embeddings"""


def _topic_totals(spark, sf):
    """Which documents have topics; their weights sum to one and none is below one percent."""
    docs = infer_topics(table(spark, sf, "documents").select("doc_id", "text"), _model(spark, sf))
    weights = F.transform("topics", lambda t: t["weight"])
    return docs.select(
        "doc_id",
        F.col("topics").isNotNull().alias("has_topics"),
        F.round(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), 6).alias("total"),
        (F.array_min(weights) >= 0.01).alias("above_least"),
        F.size(F.array_distinct("tags")).cast("long").alias("n_tags"),
    )


TOPIC_TOTALS_SQL = """
with d as (
  select doc_id, len(regexp_extract_all(regexp_replace(text, '<[^\r\n]+>', '', 'g'), '[a-zA-Z]{3,}')) > 0 as has_topics
  from documents)
select doc_id, has_topics, case when has_topics then 1.0::double end as total, case when has_topics then true end as above_least,
  case when has_topics then 10 end::bigint as n_tags
from d"""

# ---- what holds of models whatever they were fitted to

_CUT = "regexp_extract_all(regexp_replace({}, '<[^\\r\\n]+>', '', 'g'), '[a-zA-Z]{{3,}}')"
_PROSE = "coalesce(length(regexp_replace(substring({0}, 1, 1000), '[^0-9]', '', 'g')) / nullif(length(substring({0}, 1, 1000)), 0) < 0.2, false)"


def _lake_sql(preambles: bool) -> str:
    """The lake as texts, and which of its files have topics of their own: those with a word of the dictionary, which
    holds the words of all documents, in their prose or in the preamble of their table. No document or page is a table
    (`classify_documents` shows it for the documents)."""
    preamble = f"right(concat_ws(chr(10), d.text, '{LAST_PREAMBLE_LINE}'), {P.PREAMBLE_CHARS})" if preambles else "cast(null as varchar)"
    return f"""{_rendered_sql()},
lake as (
  select {DOC_PATH_SQL} as path, text, cast(null as varchar) as delimiter, cast(null as bigint) as n_rows,
         case when {_PROSE.format("text")} then text end as topic_text from documents
  union all
  select {URL_PATH_SQL}, html, null, null, case when {_PROSE.format("html")} then html end from pages
  union all
  select concat('lake/orders/', file_id, '.csv'), t.text, t.delimiter, t.n_rows, {preamble}
  from texts t left join documents d on d.doc_id = file_id),
dictionary as (select distinct unnest({_CUT.format("text")}) as word from documents),
numbered as (select row_number() over () as r, * from lake),
topical as (
  select distinct r from (select r, unnest({_CUT.format("coalesce(topic_text, '')")}) as word from numbered) join dictionary using (word)),
facts as (select numbered.*, topical.r is not null as has_topics from numbered left join topical using (r))"""


def _extract_lake_facts(spark, sf):
    """Per file of the lake what does not depend on the fit of the topic model, taken from the JSON records."""
    lines = _extract(spark, sf)
    record = F.from_json("json", RECORD_SCHEMA)
    r = lines.select(record.alias("r"))
    weights = F.transform("r.topics", lambda t: t["weight"])
    return r.select(
        "r.path", "r.size", "r.checksum", "r.delimiter", "r.n_rows", F.array_join("r.extractors", "|").alias("extractors"),
        F.round(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), 6).alias("total"), "r.topics_source", "r.error",
    )


EXTRACT_LAKE_FACTS_SQL = f"""
with {_lake_sql(True)}
select path, strlen(text) as size, sha256(text) as checksum, delimiter, n_rows,
  concat_ws('|', case when delimiter is not null then 'columnar' end, case when has_topics then 'lda' end) as extractors,
  case when has_topics then 1.0::double end as total, case when has_topics then 'own' end as topics_source,
  case when strlen(text) = 0 then 'empty content' end as error
from facts"""


def _refine_lake_sources(spark, sf):
    """Where the topics of each file of the refined lake come from; their weights sum to one."""
    ensure_checkpoint_dir(spark)
    model = _model(spark, sf)
    records = extract(lake(spark, sf), model, lda_preamble=False).checkpoint()
    weights = F.transform("topics", lambda t: t["weight"])
    return refine(records, topic_model=model).select(
        "path", "topics_source", F.round(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), 6).alias("total"), F.size("tags").alias("n_tags")
    )


REFINE_LAKE_SOURCES_SQL = f"""
with {_lake_sql(False)}
select path, case when has_topics then 'own' else 'neighbours' end as topics_source, 1.0::double as total, 10 as n_tags
from facts"""


def _column_name_counts(spark, sf):
    """Per hold-out of the name forest: its size, and whether all predictions are known names with a share of the votes."""
    predictions = train.name_holdout_predictions(_checkpointed_columns(spark, sf), "id")
    known = F.col("predicted_name").isin([n.lower() for n in (*NAMES, *ITEM_NAMES)])
    certain = (F.col("certainty") > 0) & (F.col("certainty") <= 1)
    return predictions.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(known).alias("known"), F.bool_and(certain).alias("certain")
    )


COLUMN_NAME_COUNTS_SQL = f"""
with orders_ as (select floor(o_orderkey / {KEYS_PER_TEXT}) as file_id from orders group by 1),
items as (select floor(l_orderkey / {ORDER_KEYS_PER_TEXT}) as file_id from lineitem group by 1 having count(*) >= 7),
n as (select (select count(*) * 3 from orders_) + (select count(*) * 4 from items) as n)
select split::int as split, ceil(n * 0.01)::bigint as n, true as known, true as certain from n, range(5) r(split)"""

SAMPLED_FILES = 7


def _training_set(spark, sf):
    ensure_checkpoint_dir(spark)
    rows = train.training_set(extract(order_files(spark, sf)).checkpoint(), SAMPLED_FILES)
    features = [S.round_half_away(F.col(f), F.lit(6)).alias(f) for f in S.FEATURE_NAMES]
    average = S.round_half_away(F.col("avg"), F.lit(1)).alias("avg")
    return rows.select("path", "file", "column", *features, average, F.col("null").cast("double").alias("null"))


TRAINING_SET_SQL = f"""
with p as ({TABLE_PROFILE_SQL}),
files as (select file_id, row_number() over (order by concat('lake/orders/', file_id, '.csv')) - 1 as position,
                 count(*) over () as n from (select distinct file_id from p)),
chosen as (select file_id from files
           where position in (select floor(n / {SAMPLED_FILES}.0 * j)::bigint from (select max(n) as n from files), range({SAMPLED_FILES}) r(j)))
select 'lake/orders/' as path, concat(file_id, '.csv') as file, name as column,
       min_1, {sql.rounded('min_2 - min_1', 6)} as min_diff_1, min_2, {sql.rounded('min_3 - min_2', 6)} as min_diff_2, min_3,
       max_1, {sql.rounded('max_1 - max_2', 6)} as max_diff_1, max_2, {sql.rounded('max_2 - max_3', 6)} as max_diff_2, max_3,
       {sql.rounded('avg', 1)} as avg, cast(null as double) as "null"
from p join chosen using (file_id)"""


ENTRIES = [
    Entry("classify_files", _classify, CLASSIFY_SQL),
    Entry("training_columns", _training_columns, TRAINING_COLUMNS_SQL),
    Entry("extract_tables", _extract_facts, EXTRACT_FACTS_SQL),
    Entry("infer_sentinels", _sentinels, SENTINELS_SQL),
    Entry("extract_lake", _extract, None),
    Entry("document_topics", _topics, None),
    Entry("document_tags", _tags, None),
    Entry("refine_lake", _refine, None),
    Entry("column_names", _column_names, None),
    Entry("column_name_scores", _column_name_scores, None),
    Entry("column_name_search", _column_name_search, None),
    Entry("column_name_report", _column_name_report, None),
    Entry("project_vectors", _project, None),
    Entry("projection_moments", _projection_moments, PROJECTION_SQL),
    Entry("topic_totals", _topic_totals, TOPIC_TOTALS_SQL),
    Entry("training_set", _training_set, TRAINING_SET_SQL),
    Entry("extract_lake_facts", _extract_lake_facts, EXTRACT_LAKE_FACTS_SQL),
    Entry("refine_lake_sources", _refine_lake_sources, REFINE_LAKE_SOURCES_SQL),
    Entry("column_name_counts", _column_name_counts, COLUMN_NAME_COUNTS_SQL),
]
