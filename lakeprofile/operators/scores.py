"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def macro_scores(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """(accuracy, precision, recall, n) with unweighted means over the classes of both columns.

    A class that is never predicted, or never true, scores zero on that side. The rows are first counted per
    pair of classes; everything after works on that small table.
    """
    by = by or []
    pairs = df.groupBy(*by, F.col(label).alias("_y"), F.col(prediction).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = pairs.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("_y").alias("c"), F.col("_n").alias("true"), zero.alias("pred"), hit.alias("hit")),
                F.struct(F.col("_p").alias("c"), zero.alias("true"), F.col("_n").alias("pred"), zero.alias("hit")),
            )
        ).alias("s"),
    )
    classes = sides.groupBy(*by, F.col("s.c").alias("class")).agg(
        F.sum("s.true").alias("true"), F.sum("s.pred").alias("pred"), F.sum("s.hit").alias("hit")
    )

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    return classes.groupBy(*by).agg(
        F.try_divide(F.sum("hit"), F.sum("true")).alias("accuracy"),
        F.avg(share("hit", "pred")).alias("precision"),
        F.avg(share("hit", "true")).alias("recall"),
        F.sum("true").alias("n"),
    )


def certain_only(predictions: DataFrame, threshold: float, certainty: str = "certainty") -> DataFrame:
    """Predictions whose certainty reaches the threshold."""
    return predictions.filter(F.col(certainty) >= threshold)


def validation_report(
    predictions: DataFrame, label: str, prediction: str, threshold: float, certainty: str = "certainty"
) -> DataFrame:
    """Scores of all predictions and of those within the threshold, as rows with scope ``all`` and ``certain``."""
    scopes = F.array_compact(
        F.array(F.lit("all"), F.when(F.col(certainty) >= threshold, F.lit("certain")))
    )
    return macro_scores(predictions.withColumn("scope", F.explode(scopes)), label, prediction, ["scope"])


def certainty_summary(predictions: DataFrame, threshold: float, certainty: str = "certainty") -> DataFrame:
    """(certainty_min, certainty_max, n_within, n): how many predictions reach the threshold."""
    return predictions.agg(
        F.min(certainty).alias("certainty_min"),
        F.max(certainty).alias("certainty_max"),
        F.count_if(F.col(certainty) >= threshold).alias("n_within"),
        F.count(F.lit(1)).alias("n"),
    )
