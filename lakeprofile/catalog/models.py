"""Neighbours, votes, scores, samples and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.catalog import Entry, sql, table
from lakeprofile.functions import patterns as P
from lakeprofile.functions import scalar as S
from lakeprofile.operators import neighbours as K
from lakeprofile.operators.cleaning import clean_features
from lakeprofile.operators.sampling import even_sample, holdouts, value_codes
from lakeprofile.operators.scores import certain_only, certainty_summary, macro_scores, validation_report
from lakeprofile.plans.train import knn_grid, knn_holdout_predictions

SPLITS = 100
SAMPLE = 200
THRESHOLD = 0.5


def vectors(spark, sf) -> DataFrame:
    """(id, features, label) of the embeddings."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


def _both_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    points = vectors(spark, sf)
    return points.select(F.col("id").alias("qid"), "features"), points.withColumnRenamed("id", "tid")


def _neighbours(spark, sf, broadcast_values: int = K.BROADCAST_VALUES):
    """The nine nearest other vectors of each vector."""
    queries, train = _both_sides(spark, sf)
    found = K.nearest(queries, train, mode="others", broadcast_values=broadcast_values)
    return found.select(
        "qid", "tid", F.col("rank").cast("long").alias("rank"),
        S.round_half_away(F.col("dist"), F.lit(9)).alias("dist"),
    )


_PAIRS = """
v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e, label from embeddings),
pairs as (select q.id as qid, t.id as tid, t.label, list_distance(q.e, t.e) as dist from v q join v t on q.id <> t.id),
near as (select *, row_number() over (partition by qid order by dist, tid) as rank from pairs qualify rank <= 9)"""
NEIGHBOURS_SQL = f"with {_PAIRS} select qid, tid, rank, {sql.rounded('dist', 9)} as dist from near"

_VOTES = """
votes as (select qid, label, sum(1 / dist) as w from near group by all),
predicted as (select qid, arg_max(label, (w, -label)) as prediction, max(w) / sum(w) as certainty from votes group by all)"""


def predictions(spark, sf) -> DataFrame:
    """(qid, label, prediction, certainty): each vector judged by its nearest others."""
    queries, train = _both_sides(spark, sf)
    votes = K.vote(K.nearest(queries, train, mode="others"))
    truth = train.select(F.col("tid").alias("qid"), "label")
    return votes.drop("split").join(truth, "qid")


def _rounded_predictions(df: DataFrame) -> DataFrame:
    return df.select("qid", "label", "prediction", S.round_half_away(F.col("certainty"), F.lit(6)).alias("certainty"))


_PREDICTED = f"""
select qid, v.label, prediction, {sql.rounded('certainty', 6)} as certainty from predicted join v on v.id = qid"""

_SCORES = """
{x}classes as (select distinct c from (select {y} as c from {src} union all select {p} from {src})),
{x}per_class as (select c, coalesce((select count(*) from {src} where {y} = c and {p} = c)
                                 / nullif((select count(*) from {src} where {p} = c), 0), 0) as pr,
                        coalesce((select count(*) from {src} where {y} = c and {p} = c)
                                 / nullif((select count(*) from {src} where {y} = c), 0), 0) as re
              from {x}classes),
{x}scored as (select (select count(*) from {src} where {y} = {p}) / (select count(*) from {src}) as accuracy,
                  avg(pr) as precision, avg(re) as recall, (select count(*) from {src}) as n
              from {x}per_class)"""
_SCORED = (
    f"select {sql.rounded('accuracy', 9)} as accuracy, {sql.rounded('precision', 9)} as precision, "
    f"{sql.rounded('recall', 9)} as recall, n from scored"
)


def _rounded_scores(scores: DataFrame, *by: str) -> DataFrame:
    measures = ("accuracy", "precision", "recall")
    return scores.select(*by, *[S.round_half_away(F.col(m), F.lit(9)).alias(m) for m in measures], "n")


def _holdout_scores(spark, sf):
    """Hundred random hold-outs of one percent, predicted from the rest; all predictions scored together."""
    return _rounded_scores(macro_scores(knn_holdout_predictions(vectors(spark, sf), SPLITS), "label", "prediction"))


_HELD = f"""
v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e, label from embeddings),
splits as (select unnest(range({SPLITS})) as split),
held as (select split, id, label, e from (
           select split, id, label, e, row_number() over (partition by split order by sha256(id || ':' || split), id) as k,
                  ceil(0.01 * count(*) over (partition by split)) as size
           from v, splits) where k <= size)"""
HOLDOUT_SCORES_SQL = f"""
with {_HELD},
pairs as (select q.split, q.id as qid, t.id as tid, t.label, list_distance(q.e, t.e) as dist
          from held q, v t
          where not exists (select 1 from held h where h.split = q.split and h.id = t.id)),
near as (select *, row_number() over (partition by split, qid order by dist, tid) as rank from pairs qualify rank <= 9),
votes as (select split, qid, label, sum(1 / dist) as w from near group by all),
p as (select split, qid, arg_max(label, (w, -label)) as prediction from votes group by all),
judged as (select h.label, p.prediction from held h join p on p.split = h.split and p.qid = h.id),
{_SCORES.format(src='judged', y='label', p='prediction', x='')}
{_SCORED}"""


def _grid(spark, sf):
    """Accuracy of every setting of the neighbour vote in threefold cross-validation."""
    scores = knn_grid(vectors(spark, sf))
    return scores.select("metric", "weights", "k", S.round_half_away(F.col("accuracy"), F.lit(9)).alias("accuracy"))


GRID_SQL = f"""
with v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e, label,
                  ascii(sha256(vec_id || ':' || 0)) % 3 as fold from embeddings),
pairs as (select m.metric, q.id as qid, q.label as y, t.id as tid, t.label,
                 case m.metric when 'euclidean' then list_distance(q.e, t.e)
                      else list_sum(list_transform(list_zip(q.e, t.e), lambda z: abs(z[1] - z[2]))) end as dist
          from v q join v t on q.fold <> t.fold, (values ('euclidean'), ('cityblock')) m(metric)),
near as (select *, row_number() over (partition by metric, qid order by dist, tid) as rank from pairs qualify rank <= 17),
settings as (select * from (select unnest(range(3, 18)) as k), (values ('uniform'), ('distance')) w(weights)),
votes as (select metric, weights, k, qid, y, label,
                 sum(case when weights = 'uniform' then 1 else 1 / dist end) as w
          from near join settings on rank <= k group by all),
p as (select metric, weights, k, qid, y, arg_max(label, (w, -label)) as prediction from votes group by all)
select metric, weights, k::int as k, {sql.rounded('count_if(y = prediction) / count(*)', 9)} as accuracy from p group by all"""


def _label_scores(spark, sf):
    """The toxic flag taken as a prediction of the quality flag."""
    return _rounded_scores(macro_scores(table(spark, sf, "labels"), "quality", "toxic"))


def _certainty(spark, sf):
    summary = certainty_summary(predictions(spark, sf), THRESHOLD)
    return summary.select(
        S.round_half_away(F.col("certainty_min"), F.lit(6)).alias("certainty_min"),
        S.round_half_away(F.col("certainty_max"), F.lit(6)).alias("certainty_max"),
        "n_within",
        "n",
    )


def _report(spark, sf):
    report = validation_report(predictions(spark, sf), "label", "prediction", THRESHOLD)
    return _rounded_scores(report, "scope")


_BOTH_SCORES = ", ".join(
    _SCORES.format(src=src, y="label", p="prediction", x=x) for src, x in (("judged", "all_"), ("certain", "certain_"))
)
REPORT_SQL = f"""
with {_PAIRS}, {_VOTES},
judged as (select qid, v.label, prediction, certainty from predicted join v on v.id = qid),
certain as (select * from judged where certainty >= {THRESHOLD}), {_BOTH_SCORES}
select 'all' as scope, {_SCORED.removeprefix('select ').replace('from scored', 'from all_scored')}
union all select 'certain', {_SCORED.removeprefix('select ').replace('from scored', 'from certain_scored')}"""


def _holdouts(spark, sf):
    return holdouts(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 3)


HOLDOUTS_SQL = """
select split::int as split, o_orderkey from (
  select split, o_orderkey, count(*) over (partition by split) as n,
         row_number() over (partition by split order by sha256(o_orderkey || ':' || split), o_orderkey) as k
  from orders, (select unnest(range(3)) as split))
where k <= ceil(0.01 * n)"""


def _even_sample(spark, sf):
    orders = table(spark, sf, "orders")
    return even_sample(orders, SAMPLE, "o_orderkey").select("position", "o_orderkey", "o_totalprice")


EVEN_SAMPLE_SQL = f"""
with o as (select row_number() over (order by o_orderkey) - 1 as position, o_orderkey, o_totalprice,
                  count(*) over () as n from orders)
select position, o_orderkey, o_totalprice from o
where position in (select floor((select max(n) from o)::double / {float(SAMPLE)} * j)::bigint from range({SAMPLE}) r(j))"""


def _codes(spark, sf):
    """Codes of the nations of suppliers by first appearance."""
    return value_codes(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey")


CODES_SQL = """
with f as (select s_nationkey, min(s_suppkey) as first from supplier where s_nationkey <> 0 group by all)
select 0 as s_nationkey, 0 as code union all
select s_nationkey, cast(row_number() over (order by first, s_nationkey) as integer) from f"""


def _clean(spark, sf):
    """Events as feature rows; some fields are text, missing or not finite by the type of the event."""
    value = F.col("value").cast("decimal(18,2)").cast("string")
    kind = F.col("event_type")
    fields = F.array(
        F.when(kind == "error", F.lit("n/a")).otherwise(F.format_string(" %d ", "user_id")),
        F.when(kind == "view", F.lit("inf")).when(kind == "click", F.lit("nan")).otherwise(value),
        F.when(kind != "purchase", value),
    )
    rows = table(spark, sf, "events").select("event_id", fields.alias("fields"))
    cleaned = clean_features(rows, "fields")
    return cleaned.select("event_id", *[S.item(F.col("features"), i).alias(f"f{i}") for i in range(3)])


CLEAN_SQL = """
select event_id, user_id::double as f0,
       case when event_type in ('view', 'click') then 0 else value::decimal(18,2)::double end as f1,
       case when event_type <> 'purchase' then value::decimal(18,2)::double else 0 end as f2
from events where event_type <> 'error'"""

ENTRIES = [
    Entry("knn_neighbours", _neighbours, NEIGHBOURS_SQL),
    # The same through blocks and pivots, the way for a training table above the broadcast bound.
    Entry("knn_neighbours_blocks", lambda spark, sf: _neighbours(spark, sf, broadcast_values=0), NEIGHBOURS_SQL),
    Entry(
        "knn_predict",
        lambda spark, sf: _rounded_predictions(predictions(spark, sf)),
        f"with {_PAIRS}, {_VOTES} {_PREDICTED}",
    ),
    Entry(
        "knn_certain_only",
        lambda spark, sf: _rounded_predictions(certain_only(predictions(spark, sf), THRESHOLD)),
        f"with {_PAIRS}, {_VOTES} {_PREDICTED} where predicted.certainty >= {THRESHOLD}",
    ),
    Entry(
        "knn_certainty",
        _certainty,
        f"with {_PAIRS}, {_VOTES} select {sql.rounded('min(certainty)', 6)} as certainty_min, "
        f"{sql.rounded('max(certainty)', 6)} as certainty_max, count_if(certainty >= {THRESHOLD})::bigint as n_within, "
        "count(*) as n from predicted",
    ),
    Entry("knn_validation_report", _report, REPORT_SQL),
    Entry("knn_holdout_scores", _holdout_scores, HOLDOUT_SCORES_SQL),
    Entry("knn_parameter_grid", _grid, GRID_SQL),
    Entry(
        "label_scores",
        _label_scores,
        f"with {_SCORES.format(src='labels', y='quality', p='toxic', x='')} {_SCORED}",
    ),
    Entry("holdout_rows", _holdouts, HOLDOUTS_SQL),
    Entry("even_sample", _even_sample, EVEN_SAMPLE_SQL),
    Entry("value_codes", _codes, CODES_SQL),
    Entry("clean_features", _clean, CLEAN_SQL),
]
