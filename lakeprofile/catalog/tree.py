"""The tree of page addresses and the tree of customers by region and nation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.catalog import Entry, sql, table
from lakeprofile.functions import scalar as S
from lakeprofile.operators import tree as G


def page_paths(spark, sf) -> DataFrame:
    """(page_id, path): host and path of each address, without a closing slash."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(bare, "/+$", "").alias("path"))


_PAGES = """
paths as (select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '')
                 as path from pages)"""
_PREFIXES = """
steps as (select distinct path, string_split(path, '/') as parts from paths),
prefixes as (select path, len(parts) as depth, d, array_to_string(parts[1:d], '/') as node
             from (select path, parts, unnest(range(0, len(parts) + 1)) as d from steps))"""


def _edges(spark, sf):
    return G.edges(page_paths(spark, sf))


EDGES_SQL = f"""
with {_PAGES}, {_PREFIXES}
select distinct coalesce(a.node, '') as parent, b.node as child
from prefixes a join prefixes b on a.path = b.path and b.d = a.d + 1"""


def _ancestors(spark, sf):
    return G.ancestors(page_paths(spark, sf).select("path").distinct()).withColumn("up", F.col("up").cast("long"))


ANCESTORS_SQL = f"""
with {_PAGES}, {_PREFIXES}
select path, coalesce(node, '') as ancestor, depth - d as up from prefixes"""


def _mix(paths: DataFrame, labelled: DataFrame) -> DataFrame:
    unlabelled = paths.join(labelled.select("path").distinct(), "path", "left_anti")
    mixed = G.nearest_mix(unlabelled, labelled)
    return mixed.select(
        "path",
        "topic",
        S.round_half_away(F.col("weight"), F.lit(9)).alias("weight"),
        F.col("distance").cast("long").alias("distance"),
    )


def _mix_pages(spark, sf):
    """Pages whose number carries a label have topics of their own; the others borrow them."""
    pages, labels = page_paths(spark, sf), table(spark, sf, "labels")
    rows = pages.join(labels, pages.page_id == labels.doc_id)
    topics = F.array(
        F.struct(F.col("quality").alias("topic"), F.lit(0.75).alias("weight")),
        F.struct((F.col("toxic") + 2).alias("topic"), F.lit(0.25).alias("weight")),
    )
    labelled = rows.select("path", F.explode(topics).alias("t")).select("path", "t.topic", "t.weight")
    return _mix(pages.select("path"), labelled)


_NEAREST = f"""
ab as (select q.path, l.topic, l.weight, l.file,
              len(string_split(q.path, '/')) + len(string_split(l.file, '/'))
              - 2 * (select count(*) from range(1, least(len(string_split(q.path, '/')), len(string_split(l.file, '/'))) + 1) r(i)
                     where string_split(q.path, '/')[1:r.i] = string_split(l.file, '/')[1:r.i]) as distance
       from unlabelled q, labelled l),
best as (select path, min(distance) as distance from ab group by all),
mixed as (select path, topic, distance, sum(weight) as w from ab join best using (path, distance) group by all),
scaled as (select path, topic, distance, w / sum(w) over (partition by path) as w from mixed)
select path, topic, {sql.rounded('w', 9)} as weight, distance from scaled"""

MIX_PAGES_SQL = f"""
with {_PAGES},
rows_ as (select path, quality, toxic from paths join labels on page_id = doc_id),
labelled as (select path as file, quality as topic, 0.75::double as weight from rows_
             union all select path, toxic + 2, 0.25::double from rows_),
unlabelled as (select path from paths where path not in (select path from rows_)), {_NEAREST}"""


def _mix_customers(spark, sf):
    """Region, nation and customer as a tree; customers in debt have their market segment as topic."""
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    # Region and nation are fixed lists; the customers decide the size.
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    paths = customers.select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), "c_acctbal", "c_mktsegment")
    labelled = paths.filter(F.col("c_acctbal") < 0).select(
        "path", F.col("c_mktsegment").alias("topic"), F.lit(1.0).alias("weight")
    )
    return _mix(paths.select("path"), labelled)


# Customers of one nation share the answer: own nation first, then own region, then everywhere.
MIX_CUSTOMERS_SQL = f"""
with c as (select r_name, n_name, c_mktsegment as topic, c_acctbal < 0 as own,
                  concat_ws('/', r_name, n_name, c_name) as path
           from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
places as (select distinct r_name, n_name from c),
hits as (select p.r_name, p.n_name, l.topic, case when l.n_name = p.n_name then 2 when l.r_name = p.r_name then 4
                                                  else 6 end::bigint as distance, count(*) as n
         from places p, c l where l.own group by all),
best as (select r_name, n_name, min(distance) as distance from hits group by all),
mixed as (select r_name, n_name, topic, distance, n / sum(n) over (partition by r_name, n_name) as w
          from hits join best using (r_name, n_name, distance))
select c.path, m.topic, {sql.rounded('w', 9)} as weight, distance
from c join mixed m using (r_name, n_name) where not c.own"""

ENTRIES = [
    Entry("tree_edges", _edges, EDGES_SQL),
    Entry("tree_ancestors", _ancestors, ANCESTORS_SQL),
    Entry("nearest_mix_pages", _mix_pages, MIX_PAGES_SQL),
    Entry("nearest_mix_customers", _mix_customers, MIX_CUSTOMERS_SQL),
]
