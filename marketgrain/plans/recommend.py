"""Category co-purchase recommendations and popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.scalars import ratio
from marketgrain.operators.keys import not_null, top_per_key
from marketgrain.plans.order_level import delivered_orders


def order_categories(items: DataFrame, order_level: DataFrame, category: str = "product_category") -> DataFrame:
    """Distinct (order, category) of delivered orders."""
    held = not_null(items.select("order_id", F.col(category).alias("product_category")), "product_category").distinct()
    return held.join(delivered_orders(order_level).select("order_id"), "order_id", "left_semi")


def category_orders(categories: DataFrame) -> DataFrame:
    return categories.groupBy("product_category").agg(F.count(F.lit(1)).alias("orders"))


def popularity(categories: DataFrame, count: int = 10) -> DataFrame:
    """The categories in the most delivered orders."""
    return category_orders(categories).orderBy(F.desc("orders"), "product_category").limit(count)


def recommendations(categories: DataFrame, count: int = 5) -> DataFrame:
    """For every category the ``count`` categories most often bought in the same order.

    Orders that hold the same set of categories are counted once per set, not paired one by one: the
    pairing runs over distinct sets with more than one category, and a set never has more members
    than there are categories, however many items its orders hold.
    """
    baskets = (
        categories.groupBy("order_id")
        .agg(F.array_sort(F.collect_set("product_category")).alias("basket"))
        .where(F.size("basket") > 1)
        .groupBy("basket")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    # the basket is sorted, so the members behind a position are the alphabetically later partners
    pairs = (
        baskets.select("orders", "basket", F.posexplode("basket").alias("position", "earlier"))
        .select("orders", "earlier", F.explode(F.expr("slice(basket, position + 2, size(basket))")).alias("later"))
        .groupBy("earlier", "later")
        .agg(F.sum("orders").alias("co_purchase_orders"))
    )
    forward = pairs.select(
        F.col("earlier").alias("source_category"), F.col("later").alias("recommended_category"), "co_purchase_orders"
    )
    backward = pairs.select(
        F.col("later").alias("source_category"), F.col("earlier").alias("recommended_category"), "co_purchase_orders"
    )
    sources = category_orders(categories).select(
        F.col("product_category").alias("source_category"), F.col("orders").alias("source_orders")
    )
    directed = (
        forward.unionByName(backward)
        .join(sources, "source_category")
        .withColumn("recommendation_strength", ratio(F.col("co_purchase_orders"), F.col("source_orders")))
    )
    order = [
        F.desc("co_purchase_orders"),
        F.desc("recommendation_strength"),
        F.desc(F.col("recommended_category") > F.col("source_category")),
        F.asc("recommended_category"),
    ]
    return top_per_key(directed, ["source_category"], order, count).select(
        "source_category", "recommended_category", "co_purchase_orders", "source_orders", "recommendation_strength"
    )
