from decimal import Decimal

import pytest

from marketgrain.plans.insights import slice_insights
from marketgrain.plans.kpis import kpi_row


def test_kpi_row(four_orders, three_customers):
    row = kpi_row(four_orders, three_customers).first()
    assert row["total_merchandise_revenue"] == Decimal("150.00")
    assert (row["total_delivered_orders"], row["unique_customers"], row["items_sold"]) == (2, 1, 3)
    assert (row["average_order_value"], row["average_review_score"], row["average_delivery_days"]) == (75.0, 4.0, 15.0)
    assert (row["late_delivery_rate"], row["cancellation_rate"]) == (0.5, 0.5)
    assert row["repeat_customer_rate"] == pytest.approx(1 / 3)


def test_kpi_row_without_delivered_orders(four_orders, three_customers):
    row = kpi_row(four_orders.where("order_status <> 'delivered'"), three_customers).first()
    assert (row["total_merchandise_revenue"], row["average_order_value"], row["items_sold"]) == (0, 0.0, 0)


@pytest.fixture
def selection(spark):
    rows = [
        ("o1", "c1", "delivered", 100, "Art", "AM", 0, 5.0, 10, "credit_card"),
        ("o2", "c1", "delivered", 50, "Air Conditioning", "AM", 1, 3.0, 5, "credit_card"),
        ("o3", "c2", "canceled", 999, "Other", "SP", None, None, 100, "voucher"),
    ]
    return spark.createDataFrame(
        rows,
        "order_id string, customer_unique_id string, order_status string, merchandise_revenue int, "
        "product_category string, customer_state string, late_delivery int, average_review_score double, "
        "total_freight_value int, dominant_payment_type string",
    )


def test_slice_insights_see_only_the_selection(selection):
    texts = {r["theme"]: r["insight"] for r in slice_insights(selection).collect()}
    assert len(texts) == 8
    assert "R$ 150.00 across 2 delivered orders" in texts["Scale"]
    assert "Art was the leading primary category" in texts["Primary category concentration"]
    assert "AM generated the most" in texts["Geography"]
    assert "1 of 1 unique customers" in texts["Customer retention"]
    assert "50.00% of delivered orders" in texts["Delivery risk"]
    assert "on-time orders averaged 5.00 versus 3.00" in texts["Satisfaction"]
    assert "10.0% of merchandise revenue" in texts["Freight"]
    assert texts["Payments"].startswith("Credit Card was the dominant method for 2")


def test_slice_insights_of_nothing(selection):
    assert slice_insights(selection.where("order_status = 'canceled'")).count() == 0


def test_slice_insights_without_a_late_review(selection):
    texts = {r["theme"]: r["insight"] for r in slice_insights(selection.where("order_id = 'o1'")).collect()}
    assert "does not contain enough reviewed" in texts["Satisfaction"]


def test_slice_insights_without_revenue(spark, selection):
    from pyspark.sql import functions as F

    free = selection.withColumn("merchandise_revenue", F.lit(0))
    texts = {r["theme"]: r["insight"] for r in slice_insights(free).collect()}
    assert "0.0% of merchandise revenue" in texts["Freight"]
