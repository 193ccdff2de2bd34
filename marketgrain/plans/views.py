"""Slices, headline rows, charts as tables: the data half of the dashboard."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.scalars import mean_money
from marketgrain.operators.keys import not_null
from marketgrain.operators.ranks import counted_quantiles
from marketgrain.plans.order_level import delivered_orders


def slice_orders(
    order_level: DataFrame,
    start: datetime.date | None = None,
    end: datetime.date | None = None,
    states: Sequence[str] = (),
    categories: Sequence[str] = (),
) -> DataFrame:
    """Orders bought from ``start`` to the end of day ``end``; an empty list does not filter."""
    bought = F.col("order_purchase_timestamp")
    kept = order_level
    if states:
        kept = kept.where(F.col("customer_state").isin(*states))
    if categories:
        kept = kept.where(F.col("product_category").isin(*categories))
    if start is not None:
        kept = kept.where(bought >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        kept = kept.where(bought < F.lit(end + datetime.timedelta(days=1)).cast("timestamp_ntz"))
    return kept


def filter_values(order_level: DataFrame) -> DataFrame:
    """(filter, value) rows that a user can choose from, and the first and last purchase day."""
    day = F.col("order_purchase_timestamp").cast("date")

    def choices(column: str) -> DataFrame:
        values = order_level.select(F.lit(column).alias("filter"), F.col(column).alias("value"))
        return not_null(values, "value").distinct()

    days = order_level.agg(F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"))
    return (
        choices("customer_state")
        .unionByName(choices("product_category"))
        .unionByName(days.unpivot([], ["first_day", "last_day"], "filter", "value"))
    )


def overview_measures(orders: DataFrame) -> DataFrame:
    sold = delivered_orders(orders)
    return sold.agg(
        F.sum("merchandise_revenue").alias("merchandise_revenue"),
        F.count("order_id").alias("orders"),
        F.count_distinct("customer_unique_id").alias("customers"),
        mean_money(F.col("merchandise_revenue")).alias("average_order_value"),
        F.sum("item_count").alias("items_sold"),
        F.avg("late_delivery").alias("late_delivery_rate"),
    )


def overview_monthly(orders: DataFrame) -> DataFrame:
    grouped = not_null(delivered_orders(orders), "purchase_period").groupBy("purchase_period")
    return grouped.agg(F.sum("merchandise_revenue").alias("merchandise_revenue"), F.count("order_id").alias("orders"))


def _largest(orders: DataFrame, key: str, count: int) -> DataFrame:
    grouped = not_null(delivered_orders(orders), key).groupBy(key)
    return top_rows(grouped.agg(F.sum("merchandise_revenue").alias("merchandise_revenue")), "merchandise_revenue", count, key)


def overview_categories(orders: DataFrame) -> DataFrame:
    """Twelve primary categories (the category of the order's most valuable item)."""
    return _largest(orders, "product_category", 12)


def overview_states(orders: DataFrame) -> DataFrame:
    return _largest(orders, "customer_state", 15)


def top_rows(df: DataFrame, measure: str, count: int, *ties: str) -> DataFrame:
    """The ``count`` rows with the largest measure, unknown measures last."""
    return df.orderBy(F.desc_nulls_last(measure), *ties).limit(count)


def sales_headline(monthly: DataFrame) -> DataFrame:
    """``monthly`` carries ``is_complete``."""
    latest = F.struct("purchase_period")
    return monthly.where("is_complete").agg(
        F.count(F.lit(1)).alias("complete_months"),
        F.max("merchandise_revenue").alias("peak_revenue"),
        F.max_by("merchandise_revenue", latest).alias("latest_revenue"),
        F.max_by("orders", latest).alias("latest_orders"),
    )


def growth_months(monthly: DataFrame) -> DataFrame:
    """Complete months with a known growth."""
    return monthly.where(F.col("is_complete") & F.col("revenue_growth").isNotNull()).select(
        "purchase_period", "revenue_growth"
    )


def product_headline(categories: DataFrame) -> DataFrame:
    order = F.struct(-F.col("merchandise_revenue"), "product_category")
    return categories.agg(
        F.min_by("product_category", order).alias("leading_category"),
        F.max("merchandise_revenue").alias("category_revenue"),
        F.sum("units_sold").alias("units_sold"),
        F.avg("average_review").alias("average_category_review"),
        F.count(F.lit(1)).alias("categories"),
    )


def recommendations_for(recommendations: DataFrame, popularity: DataFrame, source: str) -> DataFrame:
    """Recommendations of one category; the popular categories when there are no recommendations at all."""
    chosen = recommendations.where(F.col("source_category") == source).select(
        "recommended_category", "co_purchase_orders", "recommendation_strength"
    )
    none_at_all = recommendations.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    fallback = popularity.where(none_at_all).select(
        F.col("product_category").alias("recommended_category"),
        F.col("orders").alias("co_purchase_orders"),
        F.lit(None).cast("double").alias("recommendation_strength"),
    )
    return chosen.unionByName(fallback)


def delivery_headline(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("delivery_days").isNotNull()).agg(
        F.avg("delivery_days").alias("average_delivery_days"),
        F.avg("late_delivery").alias("late_delivery_rate"),
        mean_money(F.col("total_freight_value")).alias("average_freight"),
        F.avg("average_review_score").alias("average_review"),
    )


def slow_states(delivery_states: DataFrame, measure: str = "average_delivery_days") -> DataFrame:
    return top_rows(delivery_states, measure, 15, "customer_state").select("customer_state", measure)


def seller_scorecard(sellers: DataFrame, minimum_orders: int = 25, rows: int = 30) -> DataFrame:
    """Sellers with enough orders: least late first, then best reviewed."""
    order = [F.asc_nulls_last("late_delivery_rate"), F.desc_nulls_last("average_review_score")]
    return sellers.where(F.col("orders") >= minimum_orders).orderBy(*order, "seller_id", "seller_state").limit(rows)


def purchase_frequency(features: DataFrame, rows: int = 8) -> DataFrame:
    """Customers by number of orders, the lowest ``rows`` numbers."""
    counted = features.groupBy(F.col("total_orders").alias("orders")).agg(F.count(F.lit(1)).alias("customers"))
    return counted.orderBy("orders").limit(rows)


def histogram(
    df: DataFrame, columns: Sequence[str], bins: int = 45, cap: float | None = 0.99, by: str | None = None
) -> DataFrame:
    """Rows (measure, bin, lower, upper, rows) with equal bins from the minimum to the ``cap`` quantile.

    Values above the cap count in the last bin. Only occupied bins are listed. With ``by`` each bin is
    split by that column.
    """
    groups = [by] if by else []
    values: list[Column] = [F.col(c).cast("double").alias(c) for c in columns]
    long = df.select(*groups, *values).unpivot(groups, list(columns), "measure", "value")
    # distinct values with their copies: bounds, cap and bins all derive from this table
    counted = long.where(F.col("value").isNotNull()).groupBy(*groups, "measure", "value").agg(F.count(F.lit(1)).alias("copies"))
    bounds = counted.groupBy("measure").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    if cap is not None:
        whole = counted.groupBy("measure", "value").agg(F.sum("copies").alias("copies")) if groups else counted
        caps = counted_quantiles(whole, "value", [cap], ["measure"]).select("measure", F.col("quantile").alias("cap"))
        bounds = bounds.join(caps, "measure").select("measure", "low", F.col("cap").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    step = F.floor((F.least("value", "high") - F.col("low")) / F.when(width > 0, width))
    position = F.least(F.coalesce(step, F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        # one row of bounds per measure: the caller's list of columns
        counted.join(F.broadcast(bounds), "measure")
        .groupBy(*groups, "measure", position.alias("bin"), "low", "high")
        .agg(F.sum("copies").alias("rows"))
        .select(
            *groups,
            "measure",
            "bin",
            (F.col("low") + width * F.col("bin")).alias("lower"),
            (F.col("low") + width * (F.col("bin") + 1)).alias("upper"),
            "rows",
        )
    )


def forecast_lines(history: DataFrame, series: str) -> DataFrame:
    """(series, line, purchase_period, value): actual, predicted, future and excluded months as chart lines."""
    excluded = F.col("split") == "Excluded Partial"
    lines = {
        "Actual": F.when(~excluded, F.col("actual")),
        "Predicted": F.col("predicted"),
        "Future Forecast": F.col("future_forecast"),
        "Excluded Partial": F.when(excluded, F.col("actual")),
    }
    wide = history.select(series, "purchase_period", *[value.alias(name) for name, value in lines.items()])
    long = wide.unpivot([series, "purchase_period"], list(lines), "line", "value")
    return long.where(F.col("value").isNotNull())
