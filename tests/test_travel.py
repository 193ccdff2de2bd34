"""How often rows travel on the way to the order table, and that the shorter way gives the same rows."""

import random

from pyspark.sql import functions as F

from marketgrain.plans import grains
from registry.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_items(spark, n=600):
    pick = random.Random(3)
    rows = []
    for _ in range(n):
        order = pick.choice([None, 1, *range(1, 90)]) if pick.random() < 0.7 else 1  # order 1 is hot
        price = None if pick.random() < 0.05 else f"{pick.randrange(1, 400) / 4:.2f}"
        rows.append((order, pick.choice([None, 1, 2, 3]), pick.choice([None, *range(12)]), pick.choice([None, *range(5)]), price, "1.25"))
    rows += rows[:60]
    names = "order_id long, order_item_id int, product_id long, seller_id long, price string, freight_value string"
    items = spark.createDataFrame(rows, names)
    money = {c: F.col(c).cast("decimal(12,2)") for c in ("price", "freight_value")}
    products = spark.createDataFrame(
        [(i, f"c{i % 4}" if i % 5 else None, None if i % 3 == 0 else float(i)) for i in range(11)],
        "product_id long, product_category string, product_weight_g double",
    )
    sellers = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "seller_id long, seller_state string")
    return items.withColumns(money), products, sellers


def test_items_travel_once_to_their_orders(spark):
    plan = plan_of(grains.order_facts(*some_items(spark)))
    assert plan.count("Exchange hashpartitioning(order_id") == 1 and "Expand" not in plan


def test_order_facts_equal_both_reductions(spark):
    items, products, sellers = some_items(spark)
    context = grains.order_context(grains.categorised_folds(items, products), sellers)
    want = grains.items_per_order(items).join(context, "order_id")
    got = grains.order_facts(items, products, sellers).select(*want.columns)
    assert got.schema == want.schema or got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 80


def test_payments_travel_once(spark):
    payments = spark.createDataFrame([(1, "a", "2.00", 3)], "order_id long, payment_type string, payment_value string, payment_installments int")
    per_order = grains.payments_per_order(payments.withColumn("payment_value", F.col("payment_value").cast("decimal(12,2)")))
    assert plan_of(per_order).count("Exchange hashpartitioning(") == 1


def test_imputed_features_read_the_joins_once(small):
    assert "FileScan" not in plan_of(QUERIES["imputed_features"](small))
