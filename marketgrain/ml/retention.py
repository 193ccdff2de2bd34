"""Will a customer buy again? A dated data set, a feasibility gate, and a model if the gate is open."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.scalars import mean_money, ratio, whole_days
from marketgrain.ml import metrics as measures
from marketgrain.ml.prep import fit_preparation, joined_model
from marketgrain.operators.keys import not_null
from marketgrain.operators.ranks import running_totals
from marketgrain.plans.order_level import delivered_orders
from marketgrain.session import pin

# The published windows and the limits of the feasibility gate.
CUTOFF = datetime.datetime(2018, 3, 1)
HORIZON_END = datetime.datetime(2018, 8, 31, 23, 59, 59)
MINIMUM_POSITIVES, MINIMUM_RATE, MINIMUM_NEGATIVES = 200, 0.005, 1000
FEATURES = (
    "orders_before_cutoff",
    "spend_before_cutoff",
    "items_before_cutoff",
    "average_order_value",
    "recency_at_cutoff",
    "tenure_at_cutoff",
    "average_freight",
    "average_review",
    "late_delivery_rate",
)
TRAIN_SHARE, SEED = 0.75, 42


def retention_dataset(
    order_level: DataFrame,
    cutoff: datetime.datetime = CUTOFF,
    horizon_end: datetime.datetime = HORIZON_END,
    known_at_cutoff: bool = False,
) -> DataFrame:
    """Customers with a delivered order before ``cutoff``: nine features and ``target``.

    ``target`` is 1 when a delivered order follows from ``cutoff`` to ``horizon_end``, both included.
    With ``known_at_cutoff`` an outcome dated after the cutoff (a late flag, a review) counts as
    unknown; without it orders are cut by purchase time only.
    """
    # through text, so that no session zone shifts the moment
    start, end = (F.lit(str(moment)).cast("timestamp_ntz") for moment in (cutoff, horizon_end))
    bought = F.col("order_purchase_timestamp")
    sold = not_null(delivered_orders(order_level), "customer_unique_id")
    review, late = F.col("average_review_score"), F.col("late_delivery")
    if known_at_cutoff:
        review = F.when(F.col("review_answer_timestamp") < start, review)
        late = F.when(F.col("order_delivered_customer_date") < start, late)
    before = (
        sold.where(bought < start)
        .groupBy("customer_unique_id")
        .agg(
            F.count("order_id").alias("orders_before_cutoff"),
            F.sum("merchandise_revenue").alias("spend_before_cutoff"),
            F.sum("item_count").alias("items_before_cutoff"),
            F.min(bought).alias("first_purchase"),
            F.max(bought).alias("last_purchase"),
            mean_money(F.col("total_freight_value")).alias("average_freight"),
            F.avg(review).alias("average_review"),
            F.avg(late).alias("late_delivery_rate"),
        )
    )
    returning = (
        sold.where(bought.between(start, end))
        .groupBy("customer_unique_id")
        .agg(F.lit(1).alias("target"))
    )
    return (
        before.join(returning, "customer_unique_id", "left")
        .withColumns(
            {
                "average_order_value": ratio(F.col("spend_before_cutoff"), F.col("orders_before_cutoff")),
                "recency_at_cutoff": whole_days(F.col("last_purchase"), start),
                "tenure_at_cutoff": whole_days(F.col("first_purchase"), F.col("last_purchase")),
                "target": F.coalesce("target", F.lit(0)),
            }
        )
        .select("customer_unique_id", *FEATURES, "target")
    )


def feasibility(
    dataset: DataFrame,
    minimum_positives: int = MINIMUM_POSITIVES,
    minimum_rate: float = MINIMUM_RATE,
    minimum_negatives: int = MINIMUM_NEGATIVES,
) -> DataFrame:
    """One row: class sizes and whether a model is defensible."""
    positive = F.col("positive_count")
    return dataset.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("target") == 1).alias("positive_count"),
        F.count_if(F.col("target") == 0).alias("negative_count"),
        F.avg("target").alias("positive_rate"),
    ).withColumn(
        "model_trained",
        (positive >= minimum_positives)
        & F.coalesce(F.col("positive_rate") >= minimum_rate, F.lit(False))
        & (F.col("negative_count") >= minimum_negatives),
    )


def stratified_split(dataset: DataFrame, share: float = TRAIN_SHARE, seed: int = SEED) -> DataFrame:
    """``dataset`` with ``split``: the first ``share`` of each class in a fixed pseudo-random order trains."""
    # a hash that any engine computes alike
    shuffled = F.md5(F.concat_ws(":", F.col("customer_unique_id").cast("string"), F.lit(str(seed))).cast("binary"))
    keyed = dataset.withColumns({"__hash": shuffled, "__rows": F.lit(1).cast("bigint")})
    placed = running_totals(keyed, ["__hash", "customer_unique_id"], ["__rows"], ["target"])
    trains = F.col("__rows_before") < F.floor(F.lit(share) * F.col("__rows_total"))
    return placed.select(*dataset.columns, F.when(trains, "Training").otherwise("Test").alias("split"))


@dataclass
class RetentionResult:
    metrics: DataFrame
    predictions: DataFrame
    metadata: dict
    model: PipelineModel | None = None


def train(
    order_level: DataFrame,
    cutoff: datetime.datetime = CUTOFF,
    horizon_end: datetime.datetime = HORIZON_END,
    minimum_positives: int = MINIMUM_POSITIVES,
    minimum_rate: float = MINIMUM_RATE,
    minimum_negatives: int = MINIMUM_NEGATIVES,
) -> RetentionResult:
    """Gate, then balanced logistic regression; without a model the scores stay unknown and say why."""
    dataset = pin(retention_dataset(order_level, cutoff, horizon_end))
    gate = feasibility(dataset, minimum_positives, minimum_rate, minimum_negatives).first().asDict()
    metadata = {"prediction_start": str(cutoff), "prediction_end": str(horizon_end), **gate}
    listed = ["customer_unique_id", *FEATURES]
    if not gate["model_trained"]:
        reason = "Future-purchase target was too sparse for responsible modelling"
        metrics = dataset.sparkSession.range(1).select(F.lit("Not trained").alias("model"), F.lit(reason).alias("reason"))
        unknown = F.lit(None).cast("double").alias("future_purchase_probability")
        return RetentionResult(metrics, dataset.select(*listed, unknown), metadata)

    split = pin(stratified_split(dataset))
    training = split.where(F.col("split") == "Training")
    preparation = fit_preparation(training, FEATURES)
    weighted = measures.with_balance(preparation.transform(training).select("features", "target"), "target")
    rows = weighted.count()
    estimator = LogisticRegression(
        featuresCol="features",
        labelCol="target",
        weightCol="weight",
        regParam=1.0 / rows,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
    )
    model = joined_model(preparation, estimator.fit(weighted))
    scored = model.transform(split).select(
        *listed, "target", "split", vector_to_array("probability")[1].alias("future_purchase_probability")
    )
    tested = scored.where(F.col("split") == "Test")
    metrics = measures.classification_metrics(tested, "target", "future_purchase_probability")
    metadata |= {"train_rows": rows, "test_rows": gate["customers"] - rows}
    return RetentionResult(
        metrics.select(F.lit("Logistic Regression").alias("model"), *measures.MEASURES, F.lit(True).alias("selected")),
        scored.select(*listed, "future_purchase_probability"),
        metadata,
        model,
    )
