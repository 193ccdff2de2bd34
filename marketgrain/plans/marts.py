"""Marts over the order table.

``order_level`` has one row per order, so an order count is a row count; distinct counts are used
only where a key really repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.functions.scalars import mean_money, month_distance, ratio, whole_days
from marketgrain.operators.keys import checked_join, not_null
from marketgrain.plans.order_level import delivered_orders

def _is_delivered():
    return F.col("order_status") == "delivered"


def _total(column, kind: str = "decimal(32,2)"):
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast(kind)


def reference_day(orders: DataFrame) -> DataFrame:
    """One row: midnight after the last purchase."""
    last = F.max("order_purchase_timestamp")
    return orders.agg(F.date_add(last.cast("date"), 1).cast("timestamp_ntz").alias("as_of"))


def customer_features(order_level: DataFrame, items: DataFrame) -> DataFrame:
    """One row per durable customer."""
    first_known = F.struct("order_purchase_timestamp", "order_id")
    as_of = reference_day(order_level).scalar()
    base = (
        not_null(order_level, "customer_unique_id")
        .groupBy("customer_unique_id")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.count_if(_is_delivered()).alias("delivered_orders"),
            _total("realized_merchandise_revenue").alias("total_spend"),
            _total(F.when(_is_delivered(), F.col("item_count")), "bigint").alias("total_items"),
            F.min("order_purchase_timestamp").alias("first_purchase_date"),
            F.max("order_purchase_timestamp").alias("last_purchase_date"),
            F.avg("average_review_score").alias("average_review_score"),
            F.avg("delivery_days").alias("average_delivery_days"),
            F.avg("late_delivery").alias("late_delivery_rate"),
            # orders that were not delivered count with a realized freight of zero
            mean_money(F.col("realized_freight_value")).alias("average_freight"),
            *[
                F.min_by(c, F.when(F.col(c).isNotNull(), first_known)).alias(c)
                for c in ("customer_state", "customer_city")
            ],
        )
    )
    # a product has one category, so distinct products are distinct rows
    variety = (
        items.select("order_id", "product_id", "product_category")
        .join(delivered_orders(order_level).select("order_id", "customer_unique_id"), "order_id")
        .select("customer_unique_id", "product_id", "product_category")
        .distinct()
        .groupBy("customer_unique_id")
        .agg(
            F.count("product_id").alias("product_diversity"),
            F.count_distinct("product_category").alias("category_diversity"),
        )
    )
    return (
        base.join(variety, "customer_unique_id", "left")
        .withColumns(
            {
                "average_order_value": ratio(F.col("total_spend"), F.col("delivered_orders")),
                "recency": whole_days(F.col("last_purchase_date"), as_of),
                "frequency": F.col("delivered_orders"),
                "monetary": F.col("total_spend"),
                "customer_tenure": whole_days(F.col("first_purchase_date"), F.col("last_purchase_date")),
                "repeat_customer": F.col("total_orders") > 1,
                "product_diversity": F.coalesce("product_diversity", F.lit(0)),
                "category_diversity": F.coalesce("category_diversity", F.lit(0)),
            }
        )
    )


def monthly_sales(order_level: DataFrame, series: str | None = None) -> DataFrame:
    """Delivered sales on a spine of all months with any order; optionally one history per ``series``.

    Growth is null in the first month and after a month without revenue.
    """
    keys = [series] if series else []
    monthly = (
        not_null(order_level, "purchase_period", *keys)
        .groupBy(*keys, "purchase_period")
        .agg(
            F.count("order_id").alias("all_orders"),
            _total(F.when(_is_delivered(), F.col("merchandise_revenue"))).alias("merchandise_revenue"),
            _total(F.when(_is_delivered(), F.col("total_freight_value"))).alias("freight_value"),
            F.count_if(_is_delivered()).alias("orders"),
            F.count_distinct(F.when(_is_delivered(), F.col("customer_unique_id"))).alias("customers"),
            _total(F.when(_is_delivered(), F.col("item_count")), "bigint").alias("items_sold"),
        )
    )
    # one row per calendar month and series
    previous = F.lag("merchandise_revenue").over(Window.partitionBy(*keys).orderBy("purchase_period"))
    return monthly.withColumns(
        {
            "gross_order_value": F.col("merchandise_revenue") + F.col("freight_value"),
            "average_order_value": ratio(F.col("merchandise_revenue"), F.col("orders")),
            "revenue_growth": ratio(F.col("merchandise_revenue") - previous, previous),
        }
    )


def category_summary(items: DataFrame, order_level: DataFrame) -> DataFrame:
    """Two levels: (category, order) first, so prices, freight and reviews weigh per order."""
    per_order = (
        not_null(items, "order_id", "product_category")
        .groupBy("order_id", "product_category")
        .agg(
            F.count(F.lit(1)).alias("units"),
            _total("price").alias("revenue"),
            mean_money(F.col("price")).alias("price"),
            mean_money(F.col("freight_value")).alias("freight"),
        )
        .join(delivered_orders(order_level).select("order_id", "average_review_score"), "order_id")
    )
    summary = per_order.groupBy("product_category").agg(
        F.count("order_id").alias("order_count"),
        F.sum("units").alias("units_sold"),
        _total("revenue").alias("merchandise_revenue"),
        F.avg("price").alias("average_price"),
        F.avg("freight").alias("average_freight"),
        F.avg("average_review_score").alias("average_review"),
    )
    whole = summary.agg(F.sum("merchandise_revenue")).scalar()
    return summary.withColumn("category_share", ratio(F.col("merchandise_revenue"), whole))


def seller_summary(items: DataFrame, order_level: DataFrame, sellers: DataFrame) -> DataFrame:
    """Two levels at seller-order grain; ``category_reach`` sums the distinct categories of each order.

    A seller has one state, so the state joins the finished row per seller; sellers without a known
    state are left out.
    """
    outcome = delivered_orders(order_level).select(
        "order_id", "average_review_score", "delivery_days", "late_delivery", "customer_state"
    )
    per_seller = (
        not_null(items, "seller_id", "order_id")
        .groupBy("order_id", "seller_id")
        .agg(
            F.count(F.lit(1)).alias("units"),
            _total("price").alias("revenue"),
            F.count_distinct("product_category").alias("categories"),
        )
        .join(outcome, "order_id")
        .groupBy("seller_id")
        .agg(
            F.count("order_id").alias("orders"),
            _total("revenue").alias("merchandise_revenue"),
            F.sum("units").alias("units_sold"),
            F.avg("average_review_score").alias("average_review_score"),
            F.avg("delivery_days").alias("average_delivery_days"),
            F.avg("late_delivery").alias("late_delivery_rate"),
            F.sum("categories").alias("category_reach"),
            F.count_distinct("customer_state").alias("geographic_reach"),
        )
    )
    states = not_null(sellers.select("seller_id", "seller_state"), "seller_state")
    return checked_join(per_seller, states, "seller_id", "inner", name="sellers").select(
        "seller_id", "seller_state", *[c for c in per_seller.columns if c != "seller_id"]
    )


def active_months(order_level: DataFrame) -> DataFrame:
    """Distinct (customer, delivered month) with the customer's first month.

    After the distinct a customer has at most one row per calendar month, which bounds the window.
    """
    months = (
        delivered_orders(order_level)
        .select("customer_unique_id", F.col("purchase_period").alias("order_month"))
        .dropna()
        .distinct()
    )
    first = F.min("order_month").over(Window.partitionBy("customer_unique_id"))
    return months.withColumn("cohort_month", first).withColumn(
        "cohort_index", month_distance(F.col("cohort_month"), F.col("order_month"))
    )


def cohort_retention(order_level: DataFrame) -> DataFrame:
    cells = active_months(order_level).groupBy("cohort_month", "cohort_index").agg(F.count(F.lit(1)).alias("customers"))
    starters = F.max(F.when(F.col("cohort_index") == 0, F.col("customers")))
    sized = cells.withColumn("cohort_size", starters.over(Window.partitionBy("cohort_month")))
    return sized.withColumn("retention_rate", ratio(F.col("customers"), F.col("cohort_size")))


def cohort_matrix(cohorts: DataFrame, minimum_size: int = 100, last_index: int = 12) -> DataFrame:
    """Retention rates with one column per month distance, for cohorts large enough to read."""
    indexes = list(range(last_index + 1))
    kept = cohorts.where((F.col("cohort_size") >= minimum_size) & (F.col("cohort_index") <= last_index))
    wide = kept.groupBy("cohort_month").pivot("cohort_index", indexes).agg(F.first("retention_rate"))
    return wide.select("cohort_month", *[F.col(f"`{i}`").alias(f"month_{i:02d}") for i in indexes])


def state_sales(order_level: DataFrame) -> DataFrame:
    return (
        not_null(delivered_orders(order_level), "customer_state")
        .groupBy("customer_state")
        .agg(
            _total("merchandise_revenue").alias("merchandise_revenue"),
            F.count("order_id").alias("orders"),
            F.count_distinct("customer_unique_id").alias("customers"),
            mean_money(F.col("merchandise_revenue")).alias("average_order_value"),
        )
    )


def payment_summary(order_level: DataFrame) -> DataFrame:
    return (
        delivered_orders(order_level)
        .groupBy("dominant_payment_type")
        .agg(
            F.count("order_id").alias("orders"),
            _total("total_payment_value").alias("amount_paid"),
            F.avg("maximum_installments").alias("average_installments"),
        )
    )


def customer_state_summary(features: DataFrame) -> DataFrame:
    return (
        not_null(features, "customer_state")
        .groupBy("customer_state")
        .agg(
            F.count("customer_unique_id").alias("customers"),
            F.count_if("repeat_customer").alias("repeat_customers"),
            _total("total_spend").alias("customer_value"),
            F.avg("average_order_value").alias("average_order_value"),
        )
        .withColumn("repeat_customer_rate", ratio(F.col("repeat_customers"), F.col("customers")))
    )


def delivery_state_summary(order_level: DataFrame) -> DataFrame:
    return (
        not_null(delivered_orders(order_level), "customer_state")
        .groupBy("customer_state")
        .agg(
            F.count("order_id").alias("orders"),
            F.avg("delivery_days").alias("average_delivery_days"),
            F.avg("late_delivery").alias("late_delivery_rate"),
            mean_money(F.col("total_freight_value")).alias("average_freight"),
            F.avg("average_review_score").alias("average_review"),
        )
    )


def review_distribution(order_level: DataFrame) -> DataFrame:
    """Latest scores of delivered orders."""
    return (
        not_null(delivered_orders(order_level), "review_score")
        .groupBy("review_score")
        .agg(F.count(F.lit(1)).alias("orders"))
    )


def delay_review_summary(order_level: DataFrame) -> DataFrame:
    timing = F.when(F.col("late_delivery") == 1, "Late").otherwise("On time or early")
    return (
        not_null(delivered_orders(order_level), "review_score", "late_delivery")
        .groupBy(timing.alias("delivery_status"))
        .agg(
            F.count("order_id").alias("orders"),
            F.avg("review_score").alias("average_review"),
            F.avg("delivery_delay_days").alias("average_delay_days"),
        )
    )


def orders_by_month(order_level: DataFrame) -> DataFrame:
    return order_level.groupBy("purchase_period").agg(F.count("order_id").alias("orders"))


def late_review_counts(order_level: DataFrame) -> DataFrame:
    return (
        not_null(order_level, "late_delivery")
        .groupBy("late_delivery")
        .agg(
            F.count("average_review_score").alias("reviewed_orders"),
            F.avg("average_review_score").alias("average_review"),
        )
    )
