"""Classification quality from a confusion matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = (
    "accuracy",
    "weighted_f_measure",
    "weighted_precision",
    "weighted_true_positive_rate",
    "weighted_false_positive_rate",
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0.0)), F.lit(0.0))


def confusion_matrix(scored: DataFrame, label: str, prediction: str, *keys: str) -> DataFrame:
    """(keys..., label, prediction, n): the only pass over the scored rows."""
    return scored.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def metrics_report(scored: DataFrame, label: str, prediction: str, *keys: str) -> DataFrame:
    """Accuracy and the support-weighted rates, one row per combination of ``keys``.

    Everything after the confusion matrix works on at most classes squared rows.
    """
    matrix = confusion_matrix(scored, label, prediction, *keys)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(
            F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
            hit.alias("tp"),
        ),
        F.struct(
            F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp"),
        ),
    )
    per_class = (
        matrix.select(*keys, F.inline(sides))
        .groupBy(*keys, "cls")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("support", "predicted", "tp")])
    )
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    rates = per_class.withColumn("total", F.sum("support").over(group)).select(
        *keys,
        "support",
        "total",
        "tp",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(F.col("predicted") - F.col("tp"), F.col("total") - F.col("support")).alias("fpr"),
        _ratio(2 * precision * recall, precision + recall).alias("f"),
    )

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / F.max("total")

    values = (F.sum("tp") / F.max("total"), weighted("f"), weighted("precision"), weighted("recall"), weighted("fpr"))
    return rates.groupBy(*keys).agg(*[v.alias(n) for n, v in zip(METRICS, values)])


def accuracy_pct(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Share of rows whose prediction equals the label, in percent."""
    hit = F.when(F.col(label) == F.col(prediction), 1).otherwise(0)
    return scored.agg(
        F.count("*").alias("n"), F.sum(hit).alias("n_correct"), (100.0 * F.avg(hit)).alias("accuracy_pct")
    )
