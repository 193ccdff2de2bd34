"""Customer segments by recency, frequency and monetary value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.session import pin

RFM = ("recency", "frequency", "monetary")
CLUSTER_COUNTS = (2, 3, 4, 5, 6)
RESTARTS, SEED = 10, 42
PARALLEL_FITS = 8
UNSEGMENTED = "No Delivered Purchase"

# Names from the lowest to the highest value score, by number of clusters.
SEGMENT_NAMES = {
    2: ["Low Engagement", "High Value"],
    3: ["At Risk", "Regular", "Champions"],
    4: ["Low Engagement", "At Risk", "Loyal", "Champions"],
    5: ["Low Engagement", "At Risk", "Regular", "Loyal", "Champions"],
    6: ["Dormant", "Low Engagement", "At Risk", "Regular", "Loyal", "Champions"],
}

# What a segment means and what to do about it.
INTERPRETATIONS = {
    "Champions": (
        "Most recent, frequent, and valuable customers.",
        "Protect loyalty with early access and recognition.",
    ),
    "High Value": (
        "Customers with stronger frequency and spend than the broader base.",
        "Prioritize loyalty offers and relevant cross-sell.",
    ),
    "Loyal": ("Repeat customers with consistent value.", "Use replenishment and category-affinity campaigns."),
    "Regular": (
        "Mid-value customers with ordinary purchase patterns.",
        "Encourage a second or next purchase with targeted offers.",
    ),
    "At Risk": (
        "Customers whose recency is weaker relative to their value.",
        "Test selective re-engagement based on prior category.",
    ),
    "Low Engagement": (
        "Mostly one-order customers with lower historical engagement.",
        "Use low-cost onboarding and post-purchase journeys.",
    ),
    "Dormant": ("Long-recency, low-frequency customers.", "Limit spend and use measured win-back tests."),
}


def rfm_base(features: DataFrame) -> DataFrame:
    """Customers with a delivered order; values below zero count as zero."""
    return features.where(F.col("delivered_orders") > 0).select(
        "customer_unique_id", *[F.greatest(F.col(c), F.lit(0)).alias(c) for c in RFM]
    )


def segment_profiles(rfm: DataFrame) -> DataFrame:
    """One row per ``cluster``: size, mean R/F/M, value score and segment name.

    The score is -z(recency) + z(frequency) + z(monetary) over the clusters, with population
    deviations; a constant measure contributes nothing.
    """
    profiles = rfm.groupBy("cluster").agg(
        F.count("customer_unique_id").alias("customers"), *[F.avg(F.col(c).cast("double")).alias(c) for c in RFM]
    )
    # one row per cluster, at most six
    all_rows = Window.partitionBy()

    def z(name: str):
        spread = F.stddev_pop(name).over(all_rows)
        return (F.col(name) - F.avg(name).over(all_rows)) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)

    scored = profiles.withColumn("value_score", -z("recency") + z("frequency") + z("monetary"))
    place = F.row_number().over(Window.partitionBy().orderBy("value_score", "cluster"))
    clusters = F.count(F.lit(1)).over(all_rows)
    name = F.lit(None).cast("string")
    for count, names in SEGMENT_NAMES.items():
        listed = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("place"))
        name = F.when(F.col("clusters") == count, listed).otherwise(name)
    return (
        scored.withColumn("place", place)
        .withColumn("clusters", clusters)
        .withColumn("segment", name)
        .drop("place", "clusters")
    )


def interpretations(profiles: DataFrame) -> DataFrame:
    """Behaviour and action per segment."""

    def lookup(position: int, default: str):
        text = F.lit(default)
        for segment, parts in INTERPRETATIONS.items():
            text = F.when(F.col("segment") == segment, parts[position]).otherwise(text)
        return text

    return profiles.select(
        "segment",
        lookup(0, "Observed RFM cluster.").alias("behaviour"),
        lookup(1, "Validate messaging with controlled tests.").alias("action"),
    )


def _scaled(rfm: DataFrame) -> tuple[PipelineModel, DataFrame]:
    logs = ", ".join(f"LN(1 + CAST(`{c}` AS DOUBLE)) AS `{c}__log`" for c in RFM)
    assembler = VectorAssembler(inputCols=[f"{c}__log" for c in RFM], outputCol="logs")
    logged = SQLTransformer(statement=f"SELECT *, {logs} FROM __THIS__")
    vectors = assembler.transform(logged.transform(rfm))
    scaler = StandardScaler(inputCol="logs", outputCol="features", withMean=True, withStd=True).fit(vectors)
    model = PipelineModel(stages=[logged, assembler, scaler])
    return model, scaler.transform(vectors).select("customer_unique_id", *RFM, "features")


def best_kmeans(
    points: DataFrame,
    cluster_counts: Sequence[int],
    restarts: int = RESTARTS,
    seed: int = SEED,
    parallelism: int = PARALLEL_FITS,
) -> dict[int, KMeansModel]:
    """Per number of clusters the fit with the least inertia over ``restarts`` seeds.

    The fits share the stored points and are submitted side by side, since each is a chain of short jobs.
    """

    def fit(run: tuple[int, int]) -> tuple[int, KMeansModel]:
        clusters, restart = run
        estimator = KMeans(
            k=clusters, seed=seed + restart, maxIter=300, featuresCol="features", predictionCol="cluster"
        )
        return clusters, estimator.fit(points)

    runs = [(k, restart) for k in cluster_counts for restart in range(restarts)]
    with ThreadPool(min(parallelism, len(runs))) as pool:
        fitted = pool.map(inheritable_thread_target(points.sparkSession)(fit), runs)
    return {
        k: min((model for count, model in fitted if count == k), key=lambda model: model.summary.trainingCost)
        for k in cluster_counts
    }


def silhouettes(points: DataFrame, coordinates: Sequence[str], label_columns: Sequence[str]) -> DataFrame:
    """One row with the mean silhouette of all ``points`` per label column, by squared Euclidean distance.

    The mean squared distance from a point to a cluster follows from the cluster's size, mean and mean
    square, so the work is linear in the points: two passes per label column, no pairs. A point alone in its
    cluster, or with no other cluster, counts as zero.
    """
    square = sum((F.col(c) * F.col(c) for c in coordinates), F.lit(0.0))
    widths = []
    for label in label_columns:
        clusters = points.groupBy(F.col(label).alias("cluster")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(square).alias("square"), *[F.avg(c).alias(f"mean_{c}") for c in coordinates]
        )
        # one entry per cluster, as many as the fit was asked for
        points = points.withColumn(f"{label}_clusters", clusters.agg(F.collect_list(F.struct("*"))).scalar())
        known = F.col(f"{label}_clusters")

        def distance(cluster: Column) -> Column:
            product = sum((F.col(c) * cluster[f"mean_{c}"] for c in coordinates), F.lit(0.0))
            return F.greatest(cluster["square"] - 2 * product + square, F.lit(0.0))

        own = F.get(F.filter(known, lambda c: c["cluster"] == F.col(label)), F.lit(0))
        inside = distance(own) * own["n"] / F.nullif(own["n"] - 1, F.lit(0))
        nearest = F.array_min(F.transform(F.filter(known, lambda c: c["cluster"] != F.col(label)), distance))
        width = (nearest - inside) / F.nullif(F.greatest(nearest, inside), F.lit(0.0))
        widths.append(F.avg(F.coalesce(width, F.lit(0.0))).alias(label))
    return points.agg(*widths)


@dataclass
class SegmentationResult:
    segments: DataFrame
    profiles: DataFrame
    metrics: DataFrame
    model: PipelineModel
    metadata: dict


def train(
    features: DataFrame,
    cluster_counts: Sequence[int] = CLUSTER_COUNTS,
    restarts: int = RESTARTS,
) -> SegmentationResult:
    """K-Means on scaled logs; the number of clusters with the best silhouette, fewer on ties."""
    features = pin(features)
    scaling, vectors = _scaled(rfm_base(features))
    points = pin(vectors).persist()
    fitted = best_kmeans(points, cluster_counts, restarts)
    labelled = points
    for k, model in fitted.items():
        labelled = model.copy({model.predictionCol: f"cluster_{k}"}).transform(labelled)
    labelled = pin(labelled)
    columns = [f"cluster_{k}" for k in cluster_counts]
    places = vector_to_array("features")
    flat = labelled.select(*[places[i].alias(c) for i, c in enumerate(RFM)], *columns)
    widths = silhouettes(flat, RFM, columns).first()
    points.unpersist()

    # one row per number of clusters
    chosen = min(cluster_counts, key=lambda k: (-widths[f"cluster_{k}"], k))
    rows = [
        ("KMeans", k, float(fitted[k].summary.trainingCost), float(widths[f"cluster_{k}"]), k == chosen)
        for k in cluster_counts
    ]
    spark = features.sparkSession
    metrics = spark.createDataFrame(
        rows, "model string, clusters int, inertia double, silhouette double, selected boolean"
    )
    rfm = labelled.select("customer_unique_id", *RFM, F.col(f"cluster_{chosen}").alias("cluster"))
    profiles = pin(segment_profiles(rfm))
    segments = named_segments(features, rfm, profiles)
    return SegmentationResult(
        segments,
        profiles,
        metrics,
        PipelineModel(stages=[*scaling.stages, fitted[chosen]]),
        {
            "selected_k": chosen,
            "silhouette": float(widths[f"cluster_{chosen}"]),
            "customers_segmented": labelled.count(),
        },
    )


def named_segments(features: DataFrame, clusters: DataFrame, profiles: DataFrame) -> DataFrame:
    """``features`` with the cluster and its segment name; customers in no cluster say so."""
    # one row per cluster, at most six
    names = F.broadcast(profiles.select("cluster", "segment"))
    labels = clusters.select("customer_unique_id", "cluster").join(names, "cluster")
    joined = features.join(labels, "customer_unique_id", "left")
    return joined.withColumn("segment", F.coalesce("segment", F.lit(UNSEGMENTED)))


def largest_segment(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.desc("customers"), "segment").limit(1).select("segment", "customers")


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))


def segment_means(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(
        F.count_distinct("customer_unique_id").alias("customers"),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in RFM],
    )
