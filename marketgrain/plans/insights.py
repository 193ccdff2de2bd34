"""Findings as text rows (theme, insight).

Summaries are reduced to single values first and joined in as scalar subqueries, so the text is made
on one row and nothing but aggregates ever meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.scalars import ratio, readable
from marketgrain.plans.order_level import delivered_orders

CAUTION = " This is associative, not causal."


def _formatted(number: Column, pattern: str) -> Column:
    return F.call_function("format_number", number, F.lit(pattern))


def _count(number: Column) -> Column:
    return _formatted(number.cast("bigint"), "#,##0")


def _amount(number: Column) -> Column:
    return F.concat(F.lit("R$ "), _formatted(number, "#,##0.00"))


def _decimal(number: Column, digits: int) -> Column:
    return F.coalesce(_formatted(number, "0." + "0" * digits), F.lit("nan"))


def _percent(share: Column, digits: int = 1) -> Column:
    return F.concat(_decimal(share * 100.0, digits), F.lit("%"))


def _top(df: DataFrame, name: str, measure: str, *more: str) -> Column:
    """The row with the largest measure (ties by name) as a struct."""
    return df.orderBy(F.desc(measure), name).limit(1).select(F.struct(name, measure, *more)).scalar()


def _rows(summary: DataFrame, texts: dict[str, Column], keep: dict[str, Column] | None = None) -> DataFrame:
    """One output row per theme whose text is not null and whose ``keep`` condition holds."""
    keep = keep or {}
    cells = [
        F.struct(F.lit(theme).alias("theme"), F.when(keep[theme], text).otherwise(None).alias("insight"))
        if theme in keep
        else F.struct(F.lit(theme).alias("theme"), text.alias("insight"))
        for theme, text in texts.items()
    ]
    return summary.select(F.explode(F.array(*cells)).alias("row")).select("row.*").where(F.col("insight").isNotNull())


def business_insights(
    kpis: DataFrame,
    order_level: DataFrame,
    customers: DataFrame,
    monthly: DataFrame,
    categories: DataFrame,
    sellers: DataFrame,
    states: DataFrame,
    payments: DataFrame,
    delay_review: DataFrame,
) -> DataFrame:
    """Twelve findings. ``monthly`` is expected to hold complete months only; the peak is their maximum."""
    freight = delivered_orders(order_level).agg(F.sum("total_freight_value")).scalar()
    failed = order_level.agg(F.count_if(F.col("order_status").isin("canceled", "unavailable"))).scalar()
    repeats = customers.agg(
        F.struct(F.count_if("repeat_customer").alias("repeats"), F.count(F.lit(1)).alias("people"))
    ).scalar()
    scores = delay_review.agg(
        F.struct(
            F.max(F.when(F.col("delivery_status") == "Late", F.col("average_review"))).alias("late"),
            F.max(F.when(F.col("delivery_status") != "Late", F.col("average_review"))).alias("on_time"),
        )
    ).scalar()
    leading_sellers = sellers.orderBy(F.desc("merchandise_revenue"), "seller_id", "seller_state").limit(10)
    summary = kpis.select(
        "*",
        _top(categories, "product_category", "merchandise_revenue", "category_share").alias("category"),
        _top(states, "customer_state", "merchandise_revenue").alias("state"),
        _top(payments, "dominant_payment_type", "orders").alias("payment"),
        _top(monthly, "purchase_period", "merchandise_revenue").alias("peak"),
        repeats.alias("repeat"),
        scores.alias("score"),
        freight.alias("freight"),
        failed.alias("failed"),
        leading_sellers.agg(F.sum("merchandise_revenue")).scalar().alias("seller_revenue"),
    )
    revenue = F.col("total_merchandise_revenue")

    # The wording of the findings.
    texts = {
        "Scale": F.concat(
            F.lit("Delivered merchandise revenue was "),
            _amount(revenue),
            F.lit(" across "),
            _count(F.col("total_delivered_orders")),
            F.lit(" delivered orders."),
        ),
        "Category concentration": F.concat(
            F.col("category.product_category"),
            F.lit(" led categories with "),
            _amount(F.col("category.merchandise_revenue")),
            F.lit(", or "),
            _percent(F.col("category.category_share")),
            F.lit(" of delivered merchandise revenue."),
        ),
        "Geography": F.concat(
            F.col("state.customer_state"),
            F.lit(" generated the most delivered merchandise revenue: "),
            _amount(F.col("state.merchandise_revenue")),
            F.lit(" ("),
            _percent(ratio(F.col("state.merchandise_revenue"), revenue)),
            F.lit(" of total)."),
        ),
        "Customer retention": F.concat(
            _count(F.col("repeat.repeats")),
            F.lit(" of "),
            _count(F.col("repeat.people")),
            F.lit(" unique customers placed more than one order identity, a "),
            _percent(F.col("repeat_customer_rate"), 2),
            F.lit(" repeat-customer rate."),
        ),
        "Delivery risk": F.concat(
            _percent(F.col("late_delivery_rate"), 2),
            F.lit(" of delivered orders with valid delivery dates arrived after the estimate."),
        ),
        "Satisfaction": F.concat(
            F.lit("Average review score was "),
            _decimal(F.col("average_review_score"), 2),
            F.lit("/5; on-time orders averaged "),
            _decimal(F.col("score.on_time"), 2),
            F.lit(" versus "),
            _decimal(F.col("score.late"), 2),
            F.lit(" for late orders." + CAUTION),
        ),
        "Freight": F.concat(
            F.lit("Delivered freight totaled "),
            _percent(ratio(F.col("freight"), revenue)),
            F.lit(" of merchandise revenue, highlighting logistics as a material part of order value."),
        ),
        "Payments": F.concat(
            readable(F.col("payment.dominant_payment_type")),
            F.lit(" was the dominant method for "),
            _count(F.col("payment.orders")),
            F.lit(" delivered orders."),
        ),
        "Seasonality": F.concat(
            F.lit("The highest complete-month revenue occurred in "),
            F.date_format("peak.purchase_period", "MMMM yyyy"),
            F.lit(" at "),
            _amount(F.col("peak.merchandise_revenue")),
            F.lit("."),
        ),
        "Seller concentration": F.concat(
            F.lit("The top 10 sellers contributed "),
            _percent(ratio(F.col("seller_revenue"), revenue)),
            F.lit(" of delivered merchandise revenue."),
        ),
        "Order outcomes": F.concat(
            _count(F.col("failed")),
            F.lit(" orders were canceled or unavailable ("),
            _percent(F.col("cancellation_rate"), 2),
            F.lit(" of all orders)."),
        ),
        "Delivery duration": F.concat(
            F.lit("Average delivery time for delivered orders was "),
            _decimal(F.col("average_delivery_days"), 1),
            F.lit(" days."),
        ),
    }
    return _rows(summary, texts)


def slice_insights(order_level: DataFrame) -> DataFrame:
    """Up to eight findings for a slice of the order table; none when it holds no delivered order.

    Shares of a slice without revenue are left unknown.
    """
    keys = ["product_category", "customer_state", "dominant_payment_type", "customer_unique_id"]
    late, score = F.col("late_delivery"), F.col("average_review_score")
    # one expand: the slice by each key alone, and as a whole
    grouped = (
        delivered_orders(order_level)
        .groupingSets([[key] for key in keys] + [[]], *keys)
        .agg(
            F.grouping_id().alias("without"),
            F.sum("merchandise_revenue").alias("revenue"),
            F.count("order_id").alias("orders"),
            F.avg(late).alias("late_rate"),
            F.avg(score).alias("review"),
            F.avg(F.when(late == 0, score)).alias("on_time_review"),
            F.avg(F.when(late == 1, score)).alias("late_review"),
            F.sum("total_freight_value").alias("freight"),
        )
    )
    # a key's bit is clear where the rows are grouped by it
    every = (1 << len(keys)) - 1
    by = {key: (F.col("without") == every - (1 << (len(keys) - 1 - k))) & F.col(key).isNotNull() for k, key in enumerate(keys)}

    def leading(key: str, measure: str) -> Column:
        """The largest measure and its key, ties by key."""
        return F.min(F.when(by[key], F.struct((-F.col(measure)).alias("below"), F.col(key).alias("key"))))

    def best(name: str, key: str) -> Column:
        return F.struct(F.col(f"{name}.key").alias(key), (-F.col(f"{name}.below")).alias("measure")).alias(name)

    totals = ["revenue", "orders", "late_rate", "review", "on_time_review", "late_review", "freight"]
    buyers = by["customer_unique_id"]
    summary = grouped.agg(
        *[F.max(F.when(F.col("without") == every, F.col(c))).alias(c) for c in totals],
        leading("product_category", "revenue").alias("category"),
        leading("customer_state", "revenue").alias("state"),
        leading("dominant_payment_type", "orders").alias("payment"),
        F.struct(F.count_if(buyers & (F.col("orders") > 1)).alias("repeats"), F.count_if(buyers).alias("people")).alias("repeat"),
    ).select(
        *totals,
        best("category", "product_category"),
        best("state", "customer_state"),
        best("payment", "dominant_payment_type"),
        "repeat",
    )
    revenue = F.col("revenue")

    # The wording of the findings.
    texts = {
        "Scale": F.concat(
            F.lit("This selection generated "),
            _amount(revenue),
            F.lit(" across "),
            _count(F.col("orders")),
            F.lit(" delivered orders."),
        ),
        "Primary category concentration": F.concat(
            F.col("category.product_category"),
            F.lit(" was the leading primary category with "),
            _amount(F.col("category.measure")),
            F.lit(", or "),
            _percent(ratio(F.col("category.measure"), revenue)),
            F.lit(" of merchandise revenue."),
        ),
        "Geography": F.concat(
            F.col("state.customer_state"),
            F.lit(" generated the most merchandise revenue in this selection: "),
            _amount(F.col("state.measure")),
            F.lit(" ("),
            _percent(ratio(F.col("state.measure"), revenue)),
            F.lit(" of total)."),
        ),
        "Customer retention": F.concat(
            _count(F.col("repeat.repeats")),
            F.lit(" of "),
            _count(F.col("repeat.people")),
            F.lit(" unique customers placed more than one delivered order in this selection ("),
            _percent(ratio(F.col("repeat.repeats"), F.col("repeat.people")), 2),
            F.lit(")."),
        ),
        "Delivery risk": F.concat(
            _percent(F.col("late_rate"), 2),
            F.lit(" of delivered orders with valid delivery dates arrived after the estimate."),
        ),
        "Satisfaction": F.when(
            F.col("on_time_review").isNotNull() & F.col("late_review").isNotNull(),
            F.concat(
                F.lit("Average review score was "),
                _decimal(F.col("review"), 2),
                F.lit("/5; on-time orders averaged "),
                _decimal(F.col("on_time_review"), 2),
                F.lit(" versus "),
                _decimal(F.col("late_review"), 2),
                F.lit(" for late orders." + CAUTION),
            ),
        ).otherwise(
            F.concat(
                F.lit("Average review score was "),
                _decimal(F.col("review"), 2),
                F.lit("/5; this selection does not contain enough reviewed on-time and late orders for a comparison."),
            )
        ),
        "Freight": F.concat(
            F.lit("Delivered freight totaled "),
            _percent(F.coalesce(ratio(F.col("freight"), revenue), F.lit(0.0))),
            F.lit(" of merchandise revenue in this selection."),
        ),
        "Payments": F.concat(
            readable(F.col("payment.dominant_payment_type")),
            F.lit(" was the dominant method for "),
            _count(F.col("payment.measure")),
            F.lit(" delivered orders in this selection."),
        ),
    }
    return _rows(summary.where(F.col("orders") > 0), texts, {"Satisfaction": F.col("review").isNotNull()})
