"""Classification measures computed on Spark, exact for any number of distinct scores.

Rows are folded per distinct score first; cumulative counts come from sums over ranges of the score, so
neither tied scores nor a large test set end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.scalars import ratio
from marketgrain.operators.ranks import value_totals

THRESHOLD = 0.5
MEASURES = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def _steps(scored: DataFrame, label: str, score: str, groups: Sequence[str]) -> DataFrame:
    """One row per distinct score, highest first, with the positives and negatives at and above it."""
    folded = scored.groupBy(*groups, score).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) != 1).alias("negatives")
    )
    placed = value_totals(folded, score, ["positives", "negatives"], groups, descending=True)
    return placed.withColumns(
        {
            "true_positives": F.col("positives_before") + F.col("positives"),
            "false_positives": F.col("negatives_before") + F.col("negatives"),
        }
    )


def _zero_safe(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def classification_metrics(
    scored: DataFrame, label: str, score: str, groups: Sequence[str] = (), threshold: float = THRESHOLD
) -> DataFrame:
    """One row per group: accuracy, precision, recall, F1 (0 where undefined), ROC-AUC, average precision.

    Average precision is step-wise: the sum over score steps of gained recall times precision.
    """
    groups = list(groups)
    hit, late = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.groupBy(*groups).agg(
        F.count_if(hit & late).alias("tp"),
        F.count_if(hit & ~late).alias("fp"),
        F.count_if(~hit & late).alias("fn"),
        F.count_if(~hit & ~late).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = counts.select(
        *groups,
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _zero_safe(tp, tp + fp).alias("precision"),
        _zero_safe(tp, tp + fn).alias("recall"),
        _zero_safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    steps = _steps(scored, label, score, groups)
    area = F.col("negatives") * (F.col("positives_before") + F.col("positives") / 2)
    gained = F.col("positives") * ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives"))
    areas = steps.groupBy(*groups).agg(
        ratio(
            F.sum(area), F.max("positives_total").cast("double") * F.max("negatives_total").cast("double")
        ).alias("roc_auc"),
        ratio(F.sum(gained), F.max("positives_total")).alias("pr_auc"),
    )
    if groups:
        return rates.join(areas, groups)
    both = areas.select(F.struct("roc_auc", "pr_auc")).scalar()
    return rates.select("*", both.alias("areas")).select("accuracy", "precision", "recall", "f1", "areas.*")


def confusion_matrix(scored: DataFrame, label: str, score: str, threshold: float = THRESHOLD) -> DataFrame:
    """Two rows (actual) by two columns (predicted)."""
    actual = F.when(F.col(label) == 1, "Actual late").otherwise("Actual on time")
    predicted = F.when(F.col(score) >= threshold, "Predicted late").otherwise("Predicted on time")
    return (
        scored.select(actual.alias("actual"), predicted.alias("predicted"))
        .groupBy("actual")
        .pivot("predicted", ["Predicted on time", "Predicted late"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def roc_curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """All points of the curve, from (0, 0) at an infinite threshold."""
    points = _steps(scored, label, score, []).select(
        ratio(F.col("false_positives"), F.col("negatives_total")).alias("false_positive_rate"),
        ratio(F.col("true_positives"), F.col("positives_total")).alias("true_positive_rate"),
        F.col(score).alias("threshold"),
    )
    start = scored.sparkSession.range(1).select(
        F.lit(0.0).alias("false_positive_rate"),
        F.lit(0.0).alias("true_positive_rate"),
        F.lit(float("inf")).alias("threshold"),
    )
    return points.unionByName(start)


def pr_curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall at every distinct threshold, and the end point (1, 0)."""
    true, false = F.col("true_positives"), F.col("false_positives")
    points = _steps(scored, label, score, []).select(
        ratio(true, true + false).alias("precision"),
        ratio(true, F.col("positives_total")).alias("recall"),
        F.col(score).alias("threshold"),
    )
    end = scored.sparkSession.range(1).select(
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return points.unionByName(end)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, rows, weight) with weight n / (classes * n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    whole = counts.agg(F.struct(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return (
        counts.select("*", whole.alias("whole"))
        .withColumn("weight", ratio(F.col("whole.n"), F.col("whole.k") * F.col("rows")))
        .drop("whole")
    )


def with_balance(df: DataFrame, label: str, column: str = "weight") -> DataFrame:
    """``df`` with the class weight of its label (two classes, so two looked-up numbers)."""
    weights = {row[label]: row["weight"] for row in class_weights(df, label).collect()}
    chosen = F.lit(1.0)
    for value, weight in weights.items():
        chosen = F.when(F.col(label) == value, F.lit(weight)).otherwise(chosen)
    return df.withColumn(column, chosen)
