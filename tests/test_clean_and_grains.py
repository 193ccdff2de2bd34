import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketgrain.functions.scalars import fractional_days, haversine_km, strip, title_case, whole_days
from marketgrain.operators import keys
from marketgrain.plans import grains, marts
from marketgrain.plans.clean import clean_products, clean_text, parse_dates
from marketgrain.plans.order_level import build_order_level


def day(text):
    return datetime.datetime.fromisoformat(text)


@pytest.mark.parametrize(
    "text", ["  a b ", "\t\n x\r\x0b\x0c", " y ", "", "agro-industry", "it's 3d", "são joão", "AÇÃO x9y"]
)
def test_text_functions_equal_python(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    row = frame.select(strip(F.col("t")).alias("s"), title_case(F.col("t")).alias("c")).first()
    assert row["s"] == text.strip()
    assert row["c"] == text.title()


def test_whole_days_floor(spark):
    frame = spark.createDataFrame([(day("2020-01-02"), day("2020-01-01T12:00:00"))], "a timestamp_ntz, b timestamp_ntz")
    assert frame.select(whole_days(F.col("a"), F.col("b"))).first()[0] == -1
    assert frame.select(whole_days(F.col("b"), F.col("a"))).first()[0] == 0


def test_elapsed_time_ignores_the_session_zone(spark):
    # a clock change lies between the two times in this zone
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        frame = spark.createDataFrame([(day("2018-11-03"), day("2018-11-04"))], "a timestamp_ntz, b timestamp_ntz")
        assert frame.select(fractional_days(F.col("a"), F.col("b"))).first()[0] == 1.0
        assert frame.select(whole_days(F.col("a"), F.col("b"))).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_haversine(spark):
    frame = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (None, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    near, unknown = (r[0] for r in frame.select(haversine_km(*map(F.col, "abcd"))).collect())
    assert near == pytest.approx(3.141592653589793 * 6371.0088)
    assert unknown is None


def test_unreadable_dates_become_null(spark):
    frame = spark.createDataFrame(
        [("2018-01-01 10:00:00", None), ("invalid", "2018-02-30")], "order_purchase_timestamp string, order_approved_at string"
    )
    rows = parse_dates("orders", frame).collect()
    assert [r["order_purchase_timestamp"] for r in rows] == [day("2018-01-01T10:00:00"), None]
    assert [r["order_approved_at"] for r in rows] == [None, None]


def test_clean_products(spark):
    products = spark.createDataFrame(
        [("p1", " beleza ", 100.0), ("p2", "sem_traducao", 0.0), ("p3", None, 50.0)],
        "product_id string, product_category_name string, product_weight_g double",
    )
    words = spark.createDataFrame(
        [("beleza", "health_beauty")], "product_category_name string, product_category_name_english string"
    )
    rows = {r["product_id"]: r for r in clean_products(products, words).collect()}
    assert [rows[p]["product_category"] for p in ("p1", "p2", "p3")] == ["Health Beauty", "Sem Traducao", "Unknown"]
    assert [rows[p]["product_weight_g"] for p in ("p1", "p2", "p3")] == [100.0, None, 50.0]


def test_clean_text_keeps_other_columns(spark):
    frame = spark.createDataFrame([(1, " a ")], "n int, t string")
    assert clean_text(frame).first().asDict() == {"n": 1, "t": "a"}


def test_zip_summary(spark):
    rows = [
        (1, -23.0, -46.0, "a", "SP"),
        (1, 45.0, 121.0, "a", "SP"),
        (2, -10.0, -50.0, "b", "BA"),
        # pairs, not separate modes: (x, RJ) occurs twice, each of its parts loses to nothing
        (3, -10.0, -50.0, "x", "RJ"),
        (3, -12.0, -51.0, "x", "RJ"),
        (3, -11.0, -52.0, "y", "SP"),
        (3, -11.0, -52.0, "z", "SP"),
        # tie: state first, then city; unknown names last
        (4, None, None, None, "AA"),
        (4, None, None, "c", "AA"),
    ]
    frame = spark.createDataFrame(
        rows,
        "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, geolocation_city string, "
        "geolocation_state string",
    )
    found = {r[0]: r for r in grains.zip_summary(frame).collect()}
    assert len(found) == 4
    assert (found[1]["geolocation_lat"], found[1]["geolocation_source_rows"]) == (-23.0, 2)
    assert (found[3]["geolocation_lat"], found[3]["geolocation_lng"]) == (-11.0, -51.5)
    assert (found[3]["geolocation_state"], found[3]["geolocation_city"]) == ("RJ", "x")
    assert (found[4]["geolocation_state"], found[4]["geolocation_city"], found[4]["geolocation_lat"]) == ("AA", "c", None)


@pytest.fixture
def items(spark):
    rows = [("a", 1, "p1", "s1", 10, 2), ("a", 2, "p2", "s1", 15, 3), ("b", 1, "p1", "s2", 20, 4)]
    frame = spark.createDataFrame(
        rows, "order_id string, order_item_id int, product_id string, seller_id string, price int, freight_value int"
    )
    return frame.withColumns(
        {
            "price": F.col("price").cast("decimal(12,2)"),
            "freight_value": F.col("freight_value").cast("decimal(12,2)"),
            "shipping_limit_date": F.lit(day("2018-01-01")).cast("timestamp_ntz"),
        }
    )


def test_items_per_order(items):
    rows = {r["order_id"]: r for r in grains.items_per_order(items).collect()}
    assert sum(r["merchandise_revenue"] for r in rows.values()) == Decimal("45.00")
    assert (rows["a"]["item_count"], rows["a"]["unique_product_count"], rows["a"]["unique_seller_count"]) == (2, 2, 1)
    assert grains.order_sums(items).select("item_count").groupBy().sum().first()[0] == 3


def test_payments_per_order(spark):
    rows = [
        ("a", 1, "card", 2, 10),
        ("a", 2, "voucher", 1, 5),
        ("b", 1, "card", 1, 20),
        ("c", 1, "voucher", 1, 7),
        ("c", 2, "boleto", 3, 7),
        ("d", 1, "card", 1, 4),
        ("d", 2, "boleto", 1, 3),
        ("d", 3, "boleto", 1, 3),
    ]
    frame = spark.createDataFrame(
        rows,
        "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value int",
    ).withColumn("payment_value", F.col("payment_value").cast("decimal(12,2)"))
    found = {r["order_id"]: r for r in grains.payments_per_order(frame).collect()}
    assert found["a"]["total_payment_value"] + found["b"]["total_payment_value"] == Decimal("35.00")
    types = {o: r["dominant_payment_type"] for o, r in found.items()}
    # equal sums by name; the largest sum wins, not the largest single payment
    assert types == {"a": "card", "b": "card", "c": "boleto", "d": "boleto"}
    assert (found["d"]["payment_record_count"], found["d"]["payment_type_count"]) == (3, 2)


def test_reviews_per_order(spark):
    rows = [
        ("r", "a", 3, day("2018-01-02")),
        ("r", "b", 4, day("2018-01-03")),
        ("r2", "a", 5, day("2018-01-04")),
        ("r3", "c", 1, day("2018-01-04")),
        ("r4", "c", 2, day("2018-01-04")),
        ("r5", "d", 1, None),
        ("r6", "d", 2, day("2018-01-09")),
    ]
    frame = spark.createDataFrame(
        rows, "review_id string, order_id string, review_score int, review_answer_timestamp timestamp_ntz"
    ).withColumn("review_creation_date", F.col("review_answer_timestamp"))
    scores = {r["order_id"]: r["review_score"] for r in grains.reviews_per_order(frame).collect()}
    # the later id wins on equal times, an unknown time wins over any
    assert scores == {"a": 5, "b": 4, "c": 2, "d": 1}


def test_order_context_takes_the_most_valuable_item(spark, items):
    products = spark.createDataFrame(
        [("p1", "Art", 100.0), ("p2", "Toys", None)], "product_id string, product_category string, product_weight_g double"
    )
    sellers = spark.createDataFrame([("s1", "SP"), ("s2", "RJ")], "seller_id string, seller_state string")
    rows = {
        r["order_id"]: r
        for r in grains.order_context(grains.categorised_items(items, products), sellers).collect()
    }
    assert (rows["a"]["product_category"], rows["a"]["seller_state"]) == ("Toys", "SP")
    assert rows["a"]["average_product_weight_g"] == 100.0
    equal = items.withColumns({"price": F.lit(1).cast("decimal(12,2)"), "freight_value": F.lit(1).cast("decimal(12,2)")})
    tied = grains.order_context(grains.categorised_items(equal, products), sellers).where("order_id = 'a'").first()
    assert tied["product_category"] == "Art"


@pytest.fixture
def orders(spark):
    rows = [
        ("a", "k1", "delivered", day("2018-01-05T10:30:00"), day("2018-01-10T10:30:00"), day("2018-01-08")),
        ("b", "k2", "delivered", day("2018-02-05"), None, day("2018-02-20")),
        ("z", "k3", "shipped", day("2018-03-01"), day("2018-04-01"), day("2018-03-05")),
    ]
    return spark.createDataFrame(
        rows,
        "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    )


@pytest.fixture
def customers(spark):
    rows = [("k1", "u1", "SP", "x"), ("k2", "u1", "RJ", "y"), ("k3", "u2", "SP", None)]
    return spark.createDataFrame(
        rows, "customer_id string, customer_unique_id string, customer_state string, customer_city string"
    )


def test_order_level(orders, customers, items):
    level = build_order_level(orders, customers=customers, items=grains.items_per_order(items))
    rows = {r["order_id"]: r for r in level.collect()}
    assert len(rows) == 3
    a, b, z = rows["a"], rows["b"], rows["z"]
    assert (a["purchase_weekday"], a["purchase_hour"], a["purchase_period"]) == (4, 10, day("2018-01-01"))
    assert (a["delivery_days"], a["late_delivery"], a["gross_order_value"]) == (5.0, 1, Decimal("30.00"))
    # lateness is unknown without a date and for every other status
    assert (b["late_delivery"], z["late_delivery"]) == (None, None)
    # an order without items keeps its row
    assert (z["item_count"], z["merchandise_revenue"], z["realized_merchandise_revenue"]) == (0, 0, 0)


def test_customer_features_first_known_place(orders, customers, items, spark):
    reviews = spark.createDataFrame([], "order_id string, average_review_score double, review_count long")
    level = build_order_level(orders, customers=customers, items=grains.items_per_order(items), reviews=reviews)
    products = spark.createDataFrame(
        [("p1", "Art", 1.0), ("p2", "Art", 1.0)], "product_id string, product_category string, product_weight_g double"
    )
    rows = {
        r["customer_unique_id"]: r
        for r in marts.customer_features(level, grains.categorised_items(items, products)).collect()
    }
    u1, u2 = rows["u1"], rows["u2"]
    assert (u1["customer_state"], u1["customer_city"], u1["repeat_customer"]) == ("SP", "x", True)
    assert (u1["total_spend"], u1["average_order_value"], u1["total_items"]) == (Decimal("45.00"), 22.5, 3)
    assert (u1["product_diversity"], u1["category_diversity"], u1["customer_tenure"]) == (2, 1, 30)
    # reference day is 2018-03-02
    assert (u1["recency"], u2["recency"]) == (25, 1)
    assert (u2["average_order_value"], u2["total_spend"], u2["product_diversity"]) == (None, 0, 0)


def test_growth_after_a_month_without_revenue_is_unknown(spark):
    rows = [("a", "u", "delivered", 1, 0), ("b", "u", "delivered", 2, 10), ("c", "u", "delivered", 3, 15)]
    frame = spark.createDataFrame(
        rows, "order_id string, customer_unique_id string, order_status string, m int, merchandise_revenue int"
    ).select(
        "*",
        F.make_timestamp_ntz(F.lit(2018), "m", F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("purchase_period"),
        F.lit(0).alias("total_freight_value"),
        F.lit(1).alias("item_count"),
    )
    growth = [r["revenue_growth"] for r in marts.monthly_sales(frame).orderBy("purchase_period").collect()]
    assert growth == [None, None, 0.5]


def test_sums_survive_every_grain_and_row_order(small):
    price = small.tables["order_items"].groupBy().agg(F.sum("price")).first()[0]
    assert small.items_per_order.groupBy().agg(F.sum("merchandise_revenue")).first()[0] == price
    assert small.orders("sums").groupBy().agg(F.sum("merchandise_revenue")).first()[0] == price
    shuffled = small.tables["order_items"].orderBy(F.rand(7))
    assert grains.items_per_order(shuffled).exceptAll(small.items_per_order).count() == 0


def test_verified_sides_are_not_checked_again(spark, small):
    """A key that a run has verified is trusted inside the run, and checked again outside of it."""
    left = spark.createDataFrame([(1,)], "k int")
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with keys.verified_keys(["products"]):
        assert keys.checked_join(left, twice, "k", name="products").count() == 2
        with pytest.raises(Exception, match="not unique"):
            keys.checked_join(left, twice, "k", name="sellers").collect()
    with pytest.raises(Exception, match="not unique"):
        keys.checked_join(left, twice, "k", name="products").collect()


def test_item_folds_tell_equal_lines_apart(spark):
    """Equal values go by item number; an unknown value comes last; repeated item numbers by product and seller."""
    rows = [
        ("a", 2, "p2", "s1", "5.00"), ("a", 1, "p1", "s2", "5.00"), ("a", 3, "p3", "s3", None),
        ("b", 1, "p9", "s9", "7.00"), ("b", 1, "p1", "s3", "7.00"), ("b", 1, "p1", "s2", "7.00"),
        ("c", 4, "p4", "s4", None), ("c", 2, "p2", "s2", None), ("d", 1, "p1", "s1", "-3.00"), ("d", 2, "p2", "s2", "-2.50"),
    ]
    items = spark.createDataFrame(rows, "order_id string, order_item_id int, product_id string, seller_id string, price string")
    money = {c: F.col("price").cast("decimal(12,2)") for c in ("price", "freight_value")}
    items = items.withColumns(money | {"shipping_limit_date": F.lit(day("2018-01-01")).cast("timestamp_ntz")})
    products = spark.createDataFrame([(f"p{k}", f"C{k}", float(k)) for k in range(1, 10)], "product_id string, product_category string, product_weight_g double")
    sellers = spark.createDataFrame([(f"s{k}", f"S{k}") for k in range(1, 10)], "seller_id string, seller_state string")
    facts = {r["order_id"]: r for r in grains.order_facts(items, products, sellers).collect()}
    assert {o: (r["product_category"], r["seller_state"]) for o, r in facts.items()} == {
        "a": ("C1", "S2"), "b": ("C1", "S2"), "c": ("C2", "S2"), "d": ("C2", "S2")
    }
    assert (facts["a"]["item_count"], facts["a"]["unique_product_count"], facts["b"]["unique_seller_count"]) == (3, 3, 3)
    assert facts["b"]["average_product_weight_g"] == pytest.approx(11 / 3)
    context = {r["order_id"]: r for r in grains.order_context(grains.categorised_items(items, products), sellers).collect()}
    assert all(context[o][c] == facts[o][c] for o in facts for c in ("product_category", "seller_state", "average_product_weight_g"))
