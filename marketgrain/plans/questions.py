"""Thirty business questions over the source tables.

Each takes the table dictionary of a ``Marketplace`` and returns a DataFrame. Items are folded to the
grain a question needs before they meet the orders; ties behind a limit are broken by the group key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.functions.scalars import fractional_days, mean_money, month_distance, month_start, ratio
from marketgrain.operators.keys import first_per_key
from marketgrain.operators.ranks import running_shares

Tables = Mapping[str, DataFrame]

def _delivered(t: Tables, *columns: str | Column) -> DataFrame:
    return t["orders"].where(F.col("order_status") == "delivered").select("order_id", *columns)

def _named(t: Tables) -> DataFrame:
    """product_id and its category: translated, else the source name, else Unknown."""
    category = F.coalesce("product_category_name_english", "product_category_name", F.lit("Unknown"))
    return t["products"].select("product_id", category.alias("category"))

def _order_revenue(t: Tables) -> DataFrame:
    """Price and freight per order that has items."""
    return t["order_items"].groupBy("order_id").agg(F.sum("price").alias("revenue"), F.sum("freight_value").alias("freight"))

def _category_orders(t: Tables, *columns: str | Column) -> DataFrame:
    """Revenue per category and delivered order: an order meets its items once per category."""
    items = t["order_items"].select("order_id", "product_id", "price").join(_named(t), "product_id")
    folded = items.groupBy("order_id", "category").agg(F.sum("price").alias("revenue"))
    return folded.join(_delivered(t, *columns), "order_id")

def _people(t: Tables, *columns: str) -> DataFrame:
    return t["customers"].select("customer_id", *columns)

def _latest_scores(t: Tables) -> DataFrame:
    order = [F.desc_nulls_first("review_answer_timestamp"), F.desc_nulls_first("review_id")]
    return first_per_key(t["reviews"], ["order_id"], order).select("order_id", "review_score")

def _late() -> Column:
    """1 when the parcel came after the promise, else 0 (also when a date is missing)."""
    return F.when(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"), 1.0).otherwise(0.0)

_DATES = ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date")

def _arrived(t: Tables, *columns: str) -> DataFrame:
    return _delivered(t, *_DATES, *columns).where(F.col("order_delivered_customer_date").isNotNull())

def q01(t: Tables) -> DataFrame:
    """Delivered merchandise revenue."""
    return _order_revenue(t).join(_delivered(t), "order_id").agg(F.sum("revenue").alias("merchandise_revenue"))

def q02(t: Tables) -> DataFrame:
    """Delivered orders."""
    return _delivered(t).agg(F.count(F.lit(1)).alias("delivered_orders"))

def q03(t: Tables) -> DataFrame:
    """Durable customers with a delivered order."""
    people = _delivered(t, "customer_id").join(_people(t, "customer_unique_id"), "customer_id")
    return people.agg(F.count_distinct("customer_unique_id").alias("unique_customers"))

def q04(t: Tables) -> DataFrame:
    """Average revenue of delivered orders that have items."""
    revenue = _order_revenue(t).join(_delivered(t), "order_id")
    return revenue.agg(mean_money(F.col("revenue")).alias("average_order_value"))

def _monthly_revenue(t: Tables) -> DataFrame:
    months = _delivered(t, month_start(F.col("order_purchase_timestamp")).alias("month"))
    return _order_revenue(t).join(months, "order_id").groupBy("month").agg(F.sum("revenue").alias("revenue"))

def q05(t: Tables) -> DataFrame:
    """Monthly delivered revenue."""
    return _monthly_revenue(t).withColumnRenamed("revenue", "merchandise_revenue").orderBy("month")

def q06(t: Tables) -> DataFrame:
    """Monthly delivered orders."""
    months = _delivered(t, month_start(F.col("order_purchase_timestamp")).alias("month"))
    return months.groupBy("month").agg(F.count(F.lit(1)).alias("orders")).orderBy("month")

def q07(t: Tables) -> DataFrame:
    """Month-over-month revenue growth; null after a month without revenue."""
    # one row per calendar month
    before = F.lag("revenue").over(Window.partitionBy().orderBy("month"))
    return _monthly_revenue(t).withColumn("revenue_growth", ratio(F.col("revenue") - before, before)).orderBy("month")

def q08(t: Tables) -> DataFrame:
    """Fifteen categories with the most delivered revenue."""
    revenue = _category_orders(t).groupBy("category").agg(F.sum("revenue").alias("merchandise_revenue"))
    return revenue.orderBy(F.desc("merchandise_revenue"), "category").limit(15)

def q09(t: Tables) -> DataFrame:
    """Fifteen categories in the most delivered orders."""
    orders = _category_orders(t).groupBy("category").agg(F.count(F.lit(1)).alias("orders"))
    return orders.orderBy(F.desc("orders"), "category").limit(15)

def _seller_orders(t: Tables) -> DataFrame:
    return t["order_items"].groupBy("order_id", "seller_id").agg(F.sum("price").alias("revenue"))

def q10(t: Tables) -> DataFrame:
    """Twenty sellers with the most delivered revenue."""
    sellers = (
        _seller_orders(t)
        .join(_delivered(t), "order_id")
        .groupBy("seller_id")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("merchandise_revenue"))
    )
    return sellers.orderBy(F.desc("merchandise_revenue"), "seller_id").limit(20)

def q11(t: Tables, minimum_orders: int = 100) -> DataFrame:
    """Best-rated categories with enough reviewed orders, whatever the order's status."""
    held = t["order_items"].select("order_id", "product_id").join(_named(t), "product_id")
    rated = held.select("order_id", "category").distinct().join(_latest_scores(t), "order_id")
    return (
        rated.groupBy("category")
        .agg(F.count(F.lit(1)).alias("reviewed_orders"), F.avg("review_score").alias("average_review"))
        .where(F.col("reviewed_orders") >= minimum_orders)
        .orderBy(F.desc("average_review"), "category")
    )

def q12(t: Tables) -> DataFrame:
    """Durable customers by state (a person in two states counts in both)."""
    people = t["customers"].groupBy("customer_state")
    return people.agg(F.count_distinct("customer_unique_id").alias("customers")).orderBy(
        F.desc("customers"), "customer_state"
    )

def q13(t: Tables) -> DataFrame:
    """Delivered revenue by customer state."""
    revenue = (
        _order_revenue(t)
        .join(_delivered(t, "customer_id"), "order_id")
        .join(_people(t, "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(F.sum("revenue").alias("merchandise_revenue"))
    )
    return revenue.orderBy(F.desc("merchandise_revenue"), "customer_state")

def _orders_per_person(t: Tables) -> DataFrame:
    per_account = t["orders"].groupBy("customer_id").agg(F.count("order_id").alias("orders"))
    joined = per_account.join(_people(t, "customer_unique_id"), "customer_id")
    return joined.groupBy("customer_unique_id").agg(F.sum("orders").alias("orders"))

def q14(t: Tables) -> DataFrame:
    """Share of ordering customers with more than one order."""
    return _orders_per_person(t).agg(F.avg((F.col("orders") > 1).cast("double")).alias("repeat_customer_rate"))

def q15(t: Tables) -> DataFrame:
    """Payment records and amounts by type."""
    mix = t["payments"].groupBy("payment_type")
    return mix.agg(F.count(F.lit(1)).alias("payment_records"), F.sum("payment_value").alias("amount_paid")).orderBy(
        F.desc("payment_records"), "payment_type"
    )

def q16(t: Tables) -> DataFrame:
    """Payments and mean payment by type and number of installments."""
    keys = ["payment_type", "payment_installments"]
    return (
        t["payments"]
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("payments"), mean_money(F.col("payment_value")).alias("average_payment"))
        .orderBy(*keys)
    )

def q17(t: Tables) -> DataFrame:
    """Mean fractional days from purchase to delivery."""
    days = fractional_days(F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date"))
    return _arrived(t).agg(F.avg(days).alias("average_delivery_days"))

def q18(t: Tables) -> DataFrame:
    """Share of late parcels among delivered orders with a delivery date."""
    return _arrived(t).agg(F.avg(_late()).alias("late_delivery_rate"))

def q19(t: Tables) -> DataFrame:
    """Late share by customer state."""
    return (
        _arrived(t, "customer_id")
        .join(_people(t, "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(F.count(F.lit(1)).alias("delivered_orders"), F.avg(_late()).alias("late_delivery_rate"))
        .orderBy(F.desc("late_delivery_rate"), "customer_state")
    )

def q20(t: Tables) -> DataFrame:
    """Score distribution over raw review rows."""
    return t["reviews"].groupBy("review_score").agg(F.count(F.lit(1)).alias("reviews")).orderBy("review_score")

def q21(t: Tables) -> DataFrame:
    """Orders and mean latest score, late against on time."""
    timing = F.when(_late() == 1.0, "Late").otherwise("On time or early").alias("delivery_status")
    scored = _arrived(t).join(_latest_scores(t), "order_id")
    return scored.groupBy(timing).agg(F.count(F.lit(1)).alias("orders"), F.avg("review_score").alias("average_review"))

def q22(t: Tables) -> DataFrame:
    """Freight over merchandise of delivered orders."""
    sums = _order_revenue(t).join(_delivered(t), "order_id")
    return sums.agg(ratio(F.sum("freight"), F.sum("revenue")).alias("freight_to_merchandise_ratio"))

def q23(t: Tables) -> DataFrame:
    """Hundred customers with the highest delivered spend."""
    spend = (
        _order_revenue(t)
        .join(_delivered(t, "customer_id"), "order_id")
        .join(_people(t, "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("historical_spend"))
    )
    return spend.orderBy(F.desc("historical_spend"), "customer_unique_id").limit(100)

def q24(t: Tables) -> DataFrame:
    """Seller scorecard at seller-order grain; a missing delivery date counts as not late."""
    outcome = _delivered(t, *_DATES).join(_latest_scores(t), "order_id", "left")
    return (
        _seller_orders(t)
        .join(outcome, "order_id")
        .groupBy("seller_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("revenue").alias("revenue"),
            F.avg("review_score").alias("average_review"),
            F.avg(_late()).alias("late_delivery_rate"),
        )
        .orderBy(F.desc("revenue"), "seller_id")
    )

def q25(t: Tables) -> DataFrame:
    """Canceled and unavailable orders by month."""
    failed = t["orders"].where(F.col("order_status").isin("canceled", "unavailable"))
    month = month_start(F.col("order_purchase_timestamp")).alias("month")
    return failed.groupBy(month, "order_status").agg(F.count(F.lit(1)).alias("orders")).orderBy("month", "order_status")

def q26(t: Tables) -> DataFrame:
    """Category share and running share from the largest down; equal revenues share one running value."""
    revenue = _category_orders(t).groupBy("category").agg(F.sum("revenue").alias("revenue"))
    return running_shares(revenue, "revenue").orderBy(F.desc("revenue"), "category")

def q27(t: Tables) -> DataFrame:
    """Distinct products and categories per customer, delivered orders."""
    buyers = _delivered(t, "customer_id").join(_people(t, "customer_unique_id"), "customer_id")
    bought = (
        t["order_items"]
        .select("order_id", "product_id")
        .join(buyers, "order_id")
        .select("customer_unique_id", "product_id")
        .distinct()
        .join(_named(t), "product_id")
    )
    # a product has one category, so distinct products are distinct rows
    return bought.groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("products"), F.count_distinct("category").alias("categories")
    )

def q28(t: Tables) -> DataFrame:
    """Category rank by revenue within each year."""
    yearly = (
        _category_orders(t, F.year("order_purchase_timestamp").alias("year"))
        .groupBy("year", "category")
        .agg(F.sum("revenue").alias("revenue"))
    )
    rank = F.dense_rank().over(Window.partitionBy("year").orderBy(F.desc("revenue")))
    return yearly.withColumn("revenue_rank", rank).orderBy("year", "revenue_rank", "category")

def q29(t: Tables) -> DataFrame:
    """Customers by number of orders."""
    return _orders_per_person(t).groupBy("orders").agg(F.count(F.lit(1)).alias("customers")).orderBy("orders")

def q30(t: Tables) -> DataFrame:
    """Active customers by acquisition month and order month."""
    months = (
        _delivered(t, "customer_id", month_start(F.col("order_purchase_timestamp")).alias("order_month"))
        .join(_people(t, "customer_unique_id"), "customer_id")
        .select("customer_unique_id", "order_month")
        .distinct()
    )
    # at most one row per customer and calendar month
    joined = months.withColumn("cohort_month", F.min("order_month").over(Window.partitionBy("customer_unique_id")))
    return (
        joined.groupBy("cohort_month", "order_month")
        .agg(F.count(F.lit(1)).alias("active_customers"))
        .withColumn("cohort_index", month_distance(F.col("cohort_month"), F.col("order_month")))
        .orderBy("cohort_month", "order_month")
    )

QUESTIONS = {f"q{i:02d}": globals()[f"q{i:02d}"] for i in range(1, 31)}
