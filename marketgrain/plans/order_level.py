"""The order table: one wide row per order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.scalars import fractional_days, haversine_km, month_start
from marketgrain.operators.keys import checked_join

# Columns of the order table that are filled where an order lacks the part, and with what.
COUNTS = (
    "item_count",
    "unique_product_count",
    "unique_seller_count",
    "payment_record_count",
    "payment_type_count",
    "review_count",
)
AMOUNTS = ("merchandise_revenue", "total_freight_value", "total_payment_value")
LABELS = {"product_category": "Unknown", "seller_state": "Unknown", "dominant_payment_type": "not_available"}


def build_order_level(
    orders: DataFrame,
    customers: DataFrame | None = None,
    items: DataFrame | None = None,
    payments: DataFrame | None = None,
    reviews: DataFrame | None = None,
    context: DataFrame | None = None,
) -> DataFrame:
    """Orders joined with the per-order reductions and the customer, plus derived columns.

    The four reductions are unique on ``order_id`` (they are grouped by it) and joined first, so
    ``orders`` is shuffled on ``order_id`` once; customers follow under a key check. A part that is
    left out leaves out its columns: marts ask only for the parts they read.
    """
    joined = orders
    for part in (items, payments, reviews, context):
        if part is not None:
            joined = joined.join(part, "order_id", "left")
    if customers is not None:
        joined = checked_join(joined, customers, "customer_id", name="customers")

    present = set(joined.columns)
    joined = joined.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTS if c in present},
            **{c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(22,2)") for c in AMOUNTS if c in present},
            **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in LABELS.items() if c in present},
        }
    )

    bought, arrived = F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    promised, delivered = F.col("order_estimated_delivery_date"), F.col("order_status") == "delivered"
    derived = {
        "purchase_year": F.year(bought),
        "purchase_month": F.month(bought),
        "purchase_weekday": F.weekday(bought),
        "purchase_hour": F.hour(bought),
        "purchase_period": month_start(bought),
        "delivery_days": fractional_days(bought, arrived),
        "delivery_delay_days": fractional_days(promised, arrived),
        "estimated_delivery_days": fractional_days(bought, promised),
        # unknown unless the order was delivered and both dates exist
        "late_delivery": F.when(delivered, (arrived > promised).cast("int")),
    }
    if "merchandise_revenue" in present:
        derived["gross_order_value"] = F.col("merchandise_revenue") + F.col("total_freight_value")
        nothing = F.lit(0).cast("decimal(22,2)")
        derived["realized_merchandise_revenue"] = F.when(delivered, F.col("merchandise_revenue")).otherwise(nothing)
        derived["realized_freight_value"] = F.when(delivered, F.col("total_freight_value")).otherwise(nothing)
    if {"customer_lat", "seller_lat"} <= present:
        derived["distance_km"] = haversine_km(
            F.col("customer_lat"), F.col("customer_lng"), F.col("seller_lat"), F.col("seller_lng")
        )
    return joined.withColumns(derived)


def delivered_orders(order_level: DataFrame) -> DataFrame:
    return order_level.where(F.col("order_status") == "delivered")


def delivery_slice(order_level: DataFrame) -> DataFrame:
    return order_level.select(
        "order_id",
        "order_purchase_timestamp",
        "customer_state",
        "seller_state",
        "delivery_days",
        "delivery_delay_days",
        "late_delivery",
        "total_freight_value",
        "average_review_score",
        "review_score",
        "distance_km",
    )
