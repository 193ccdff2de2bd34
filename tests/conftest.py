from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from marketgrain.session import marketplace_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = marketplace_session("tests", "local[8]", shuffle_partitions=4, spark__ui__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    from marketgrain.plans.marketplace import Marketplace

    return Marketplace.from_samples(spark, SMALL)


@pytest.fixture(scope="session")
def four_orders(spark):
    rows = [
        ("o1", "c1", "delivered", "100", 2, 5.0, 10.0, 0),
        ("o2", "c1", "delivered", "50", 1, 3.0, 20.0, 1),
        ("o3", "c2", "canceled", "80", 1, None, None, None),
        ("o4", "c3", "unavailable", "20", 1, None, None, None),
    ]
    schema = (
        "order_id string, customer_unique_id string, order_status string, merchandise_revenue string, item_count int, "
        "average_review_score double, delivery_days double, late_delivery int"
    )
    frame = spark.createDataFrame(rows, schema)
    return frame.withColumn("merchandise_revenue", frame.merchandise_revenue.cast("decimal(12,2)"))


@pytest.fixture(scope="session")
def three_customers(spark):
    return spark.createDataFrame(
        [("c1", True), ("c2", False), ("c3", False)], "customer_unique_id string, repeat_customer boolean"
    )
