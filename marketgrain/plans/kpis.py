"""Headline measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.scalars import mean_money, ratio

FAILED = ("canceled", "unavailable")


def _delivered(column):
    return F.when(F.col("order_status") == "delivered", column)


def repeat_rate(customers: DataFrame) -> DataFrame:
    return customers.agg(F.avg(F.col("repeat_customer").cast("double")).alias("repeat_customer_rate"))


def customer_repeats(order_level: DataFrame) -> DataFrame:
    """(customer_unique_id, repeat_customer): the part of the customer table the KPI row reads."""
    return (
        order_level.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg((F.count("order_id") > 1).alias("repeat_customer"))
    )


def kpi_row(order_level: DataFrame, customers: DataFrame) -> DataFrame:
    """All ten measures in one row: one pass over the orders, one over the customers."""
    revenue = F.coalesce(F.sum(_delivered(F.col("merchandise_revenue"))), F.lit(0)).cast("decimal(32,2)")
    orders = F.count(_delivered(F.col("order_id")))
    return order_level.agg(
        revenue.alias("total_merchandise_revenue"),
        orders.alias("total_delivered_orders"),
        F.count_distinct(_delivered(F.col("customer_unique_id"))).alias("unique_customers"),
        F.coalesce(ratio(revenue, orders), F.lit(0.0)).alias("average_order_value"),
        F.coalesce(F.sum(_delivered(F.col("item_count"))), F.lit(0)).alias("items_sold"),
        F.avg(_delivered(F.col("average_review_score"))).alias("average_review_score"),
        F.avg(_delivered(F.col("delivery_days"))).alias("average_delivery_days"),
        F.avg(_delivered(F.col("late_delivery"))).alias("late_delivery_rate"),
        F.avg(F.col("order_status").isin(*FAILED).cast("double")).alias("cancellation_rate"),
    ).select(
        "total_merchandise_revenue",
        "total_delivered_orders",
        "unique_customers",
        "average_order_value",
        "items_sold",
        "average_review_score",
        "average_delivery_days",
        "late_delivery_rate",
        repeat_rate(customers).scalar().alias("repeat_customer_rate"),
        "cancellation_rate",
    )


def customer_headline(features: DataFrame) -> DataFrame:
    """Five measures of the customer page."""
    return features.agg(
        F.count("customer_unique_id").alias("unique_customers"),
        F.count_if("repeat_customer").alias("repeat_customers"),
        F.avg(F.col("repeat_customer").cast("double")).alias("repeat_customer_rate"),
        mean_money(F.col("total_spend")).alias("average_customer_value"),
        F.avg("total_orders").alias("average_purchase_frequency"),
    )
