"""Late-delivery risk: chronological split, four candidates, scores for every order."""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.scalars import readable, risk_band
from marketgrain.ml import forest
from marketgrain.ml import metrics as measures
from marketgrain.ml.prep import feature_names, fit_preparation, joined_model
from marketgrain.operators.quality import require_disjoint, union_all
from marketgrain.operators.ranks import row_at
from marketgrain.session import pin

# What the model may see, all known when the order is placed.
NUMERIC = (
    "purchase_month",
    "purchase_weekday",
    "purchase_hour",
    "item_count",
    "unique_product_count",
    "unique_seller_count",
    "merchandise_revenue",
    "total_freight_value",
    "gross_order_value",
    "total_payment_value",
    "maximum_installments",
    "distance_km",
    "estimated_delivery_days",
    "average_product_weight_g",
)
CATEGORICAL = ("customer_state", "seller_state", "product_category", "dominant_payment_type")
# What becomes known only with or after the delivery, all review columns included.
FORBIDDEN = (
    "late_delivery",
    "order_delivered_customer_date",
    "order_delivered_carrier_date",
    "delivery_days",
    "delivery_delay_days",
    "review_score",
    "average_review_score",
    "review_count",
    "review_id",
    "review_creation_date",
    "review_answer_timestamp",
)
ORDER = ("order_purchase_timestamp", "order_id")
TRAIN_SHARE = 0.80
SEED = 42
BASELINE = "Dummy Baseline"
LOGISTIC, TREE, FOREST = "Logistic Regression", "Decision Tree", "Random Forest"


def training_set(order_level: DataFrame) -> DataFrame:
    """Delivered orders with known lateness: identifiers, features, label."""
    require_disjoint([*NUMERIC, *CATEGORICAL], FORBIDDEN)
    return order_level.where((F.col("order_status") == "delivered") & F.col("late_delivery").isNotNull()).select(
        "order_id", "order_purchase_timestamp", *CATEGORICAL, *NUMERIC, "late_delivery"
    )


def chronological_split(rows: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """``rows`` with ``evaluation_split``: the first int(share * n) by purchase time and id train.

    One boundary row decides every row, so nothing is sorted into a single task.
    """
    boundary = row_at(rows, ORDER, share).select(F.struct(*ORDER)).scalar()
    split = F.when(F.struct(*ORDER) < F.col("__boundary"), "Training").otherwise("Chronological test")
    return rows.select("*", boundary.alias("__boundary")).withColumn("evaluation_split", split).drop("__boundary")


def prior_baseline(split: DataFrame) -> DataFrame:
    """Test rows with the training share of late orders as their probability."""
    rate = split.where(F.col("evaluation_split") == "Training").agg(F.avg("late_delivery")).scalar()
    test = split.where(F.col("evaluation_split") != "Training")
    return test.select("order_id", "late_delivery", rate.alias("late_delivery_probability"))


@dataclass
class Settings:
    """Sizes of the candidates; the defaults are those of the published comparison."""

    tree_depth: int = 9
    tree_leaf: int = 40
    forest_trees: int = 160
    forest_depth: int = 18
    forest_leaf: int = 5
    iterations: int = 1000
    candidates: tuple[str, ...] = (LOGISTIC, TREE, FOREST)


@dataclass
class DeliveryResult:
    model: PipelineModel
    selected: str
    metrics: DataFrame
    predictions: DataFrame
    importance: DataFrame
    confusion: DataFrame
    roc: DataFrame
    pr: DataFrame
    metadata: dict = field(default_factory=dict)


def _estimators(settings: Settings, rows: int) -> dict:
    common = {"featuresCol": "features", "labelCol": "late_delivery", "weightCol": "weight"}
    every = {
        # balanced weights sum to the row count, so this is the unit-strength penalty per row
        LOGISTIC: LogisticRegression(
            regParam=1.0 / rows, elasticNetParam=0.0, standardization=False, maxIter=settings.iterations, **common
        ),
        TREE: DecisionTreeClassifier(
            maxDepth=settings.tree_depth, minInstancesPerNode=settings.tree_leaf, seed=SEED, **common
        ),
        FOREST: RandomForestClassifier(
            numTrees=settings.forest_trees,
            maxDepth=settings.forest_depth,
            minInstancesPerNode=settings.forest_leaf,
            featureSubsetStrategy="sqrt",
            # a row keeps its node, so no pass walks the grown trees again
            cacheNodeIds=True,
            seed=SEED,
            **common,
        ),
    }
    return {name: every[name] for name in settings.candidates}


def late_probability() -> Column:
    return vector_to_array("probability")[1]


def best_model(comparison: DataFrame) -> DataFrame:
    """The row of the candidate with the best F1, then average precision; the baseline is none."""
    # one row per candidate
    return comparison.where(F.col("model") != BASELINE).orderBy(F.desc("f1"), F.desc("pr_auc"), "model").limit(1)


def train(order_level: DataFrame, settings: Settings | None = None) -> DeliveryResult:
    """Fit the candidates on the earlier orders, choose by F1 then average precision on the later ones."""
    settings = settings or Settings()
    # split and fitted several times: written once, then read back without the joins behind it; a forest draws rows by
    # their place, so the place must not come from the way a join was planned
    placed = pin(training_set(order_level)).repartition("order_id").sortWithinPartitions("order_id")
    split = pin(chronological_split(placed))
    training = split.where(F.col("evaluation_split") == "Training")
    summary = split.agg(
        F.count_if(F.col("evaluation_split") == "Training").alias("train_rows"),
        F.count_if(F.col("evaluation_split") != "Training").alias("test_rows"),
        F.min(F.when(F.col("evaluation_split") != "Training", F.col("order_purchase_timestamp"))).alias("test_start"),
        F.avg(F.when(F.col("evaluation_split") == "Training", F.col("late_delivery"))).alias("positive_rate_train"),
        F.avg(F.when(F.col("evaluation_split") != "Training", F.col("late_delivery"))).alias("positive_rate_test"),
    ).first()

    preparation = fit_preparation(training, NUMERIC, CATEGORICAL)
    listed = ["order_id", "order_purchase_timestamp", "customer_state", "late_delivery", "evaluation_split"]
    kept = [*listed, "features"]
    prepared = pin(preparation.transform(split).select(*kept))
    weighted = measures.with_balance(prepared.where(F.col("evaluation_split") == "Training"), "late_delivery")

    estimators = _estimators(settings, summary["train_rows"])

    def fit(name: str) -> Model:
        if name == FOREST:
            return forest.grow(estimators[name], weighted, summary["train_rows"])
        return estimators[name].fit(weighted)

    with ThreadPool(len(estimators)) as pool:
        fitted = dict(zip(estimators, pool.map(inheritable_thread_target(split.sparkSession)(fit), estimators)))

    def scores(name: str, rows: DataFrame) -> DataFrame:
        """Written once: the votes of many trees are not counted again by every measure."""
        found = fitted[name].transform(rows).select(*listed, late_probability().alias("late_delivery_probability"))
        return pin(found)

    tests = {name: scores(name, prepared.where(F.col("evaluation_split") != "Training")) for name in fitted}
    scored = [
        prior_baseline(prepared).select(F.lit(BASELINE).alias("model"), "late_delivery", "late_delivery_probability")
    ] + [
        found.select(F.lit(name).alias("model"), "late_delivery", "late_delivery_probability")
        for name, found in tests.items()
    ]
    comparison = pin(
        measures.classification_metrics(
            union_all(scored), "late_delivery", "late_delivery_probability", ["model"]
        )
    )
    selected = best_model(comparison).first()["model"]
    model = joined_model(preparation, fitted[selected])

    every = tests[selected].unionByName(scores(selected, prepared.where(F.col("evaluation_split") == "Training")))
    predictions = every.withColumn("risk_category", risk_band(F.col("late_delivery_probability")))
    tested = predictions.where(F.col("evaluation_split") != "Training")
    pair = ("late_delivery", "late_delivery_probability")
    return DeliveryResult(
        model=model,
        selected=selected,
        metrics=comparison.withColumn("selected", F.col("model") == selected),
        predictions=predictions,
        importance=importance(fitted[selected], feature_names(prepared, NUMERIC), prepared),
        confusion=measures.confusion_matrix(tested, *pair),
        roc=measures.roc_curve(tested, *pair),
        pr=measures.pr_curve(tested, *pair),
        metadata={"selected_model": selected, **summary.asDict()},
    )


def importance(model, names: list[str], df: DataFrame, count: int = 30) -> DataFrame:
    """Tree importance or absolute coefficient per feature, the largest ``count``."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        values = abs(model.coefficients.toArray())
    ranked = sorted(zip(names, map(float, values)), key=lambda pair: (-pair[1], pair[0]))[:count]
    return df.sparkSession.createDataFrame(ranked, "feature string, importance double")


def readable_importance(importances: DataFrame, count: int = 15) -> DataFrame:
    """The largest importances under names a reader knows."""
    plain = F.regexp_replace("feature", "^(numeric|categorical)__", "")
    return importances.orderBy(F.desc("importance"), "feature").limit(count).select(
        readable(plain).alias("feature"), "importance"
    )


def score(model: PipelineModel, orders: DataFrame) -> DataFrame:
    """Probability and band for any number of new orders; the gross value is derived when it is missing."""
    if "gross_order_value" not in orders.columns:
        orders = orders.withColumn("gross_order_value", F.col("merchandise_revenue") + F.col("total_freight_value"))
    kept = [F.col(c) for c in orders.columns]
    scored = model.transform(orders).select(*kept, late_probability().alias("late_delivery_probability"))
    return scored.withColumn("risk_category", risk_band(F.col("late_delivery_probability")))
