import datetime

import pytest
from pyspark.sql import functions as F

from marketgrain import job
from marketgrain.ml import delivery
from marketgrain.plans.marketplace import Marketplace
from marketgrain.sources import readers, writers
from marketgrain.sources.schemas import DATE_COLUMNS, FOREIGN_KEYS, RELATIONAL_NAMES, REQUIRED_COLUMNS, SCHEMAS

FILES = {
    "customers": 'k1,u1,1000,"são paulo ",SP\nk2,u2,2000,rio,RJ\n',
    "orders": "a,k1,delivered,2018-01-05 10:00:00,,,2018-01-09 10:00:00,2018-01-20 00:00:00\n"
    "b,k2,canceled,bad date,,,,2018-02-20 00:00:00\n",
    "order_items": "a,1,p1,s1,2018-01-07 00:00:00,10.50,1.25\na,2,p1,s1,2018-01-07 00:00:00,4.50,0.75\n",
    "payments": "a,1,credit_card,2,17.00\n",
    "reviews": 'r1,a,5,"say ""hi""","two\nlines, one field",2018-01-10 00:00:00,2018-01-11 00:00:00\n',
    "products": "p1,beleza,3,4,1,100,0,5,6\n",
    "sellers": "s1,1000,sp,SP\n",
    "geolocation": "1000,-23.5,-46.6,sp,SP\n1000,-23.7,-46.8,sp,SP\n",
    "category_translation": "beleza,health_beauty\n",
}


@pytest.fixture
def source(tmp_path):
    for table, text in FILES.items():
        (tmp_path / f"{table}.csv").write_text(",".join(REQUIRED_COLUMNS[table]) + "\n" + text, encoding="utf-8")
    return tmp_path


def test_contract_names():
    assert len(SCHEMAS) == 9
    assert REQUIRED_COLUMNS["order_items"][-2:] == ["price", "freight_value"]
    assert len(DATE_COLUMNS["orders"]) == 5 and DATE_COLUMNS["order_items"] == ("shipping_limit_date",)
    assert DATE_COLUMNS["reviews"] == ("review_creation_date", "review_answer_timestamp")


def test_all_missing_files_are_named(spark, source):
    (source / "orders.csv").rename(source / "orders.other")
    with pytest.raises(FileNotFoundError, match="orders.csv"):
        readers.read_sources(spark, str(source))
    assert "orders" in readers.read_sources(spark, str(source), {"orders": "orders.other"})


def test_csv_sources_and_cleaning(spark, source, tmp_path):
    raw = readers.store_sources(readers.read_sources(spark, str(source)), str(tmp_path / "stored"))
    review = raw["reviews"].first()
    assert review["review_comment_title"] == 'say "hi"' and review["review_comment_message"] == "two\nlines, one field"
    m = Marketplace.from_raw(raw)
    rows = {r["order_id"]: r for r in m.order_level.collect()}
    assert rows["a"]["customer_city"] == "são paulo" and rows["a"]["product_category"] == "Health Beauty"
    assert rows["a"]["delivery_days"] == 4.0 and rows["a"]["late_delivery"] == 0
    assert rows["a"]["customer_lat"] == pytest.approx(-23.6) and rows["a"]["distance_km"] == pytest.approx(0.0)
    assert rows["b"]["order_purchase_timestamp"] is None and rows["b"]["dominant_payment_type"] == "not_available"
    assert m.tables["products"].first()["product_length_cm"] is None


def test_results_survive_a_round_trip(spark, tmp_path, small):
    folder = str(tmp_path)
    sales = small.orders("customers").groupBy("customer_state").agg(F.count(F.lit(1)).alias("orders"))
    stored = writers.write_table(sales, folder, "sales")
    assert stored.exceptAll(sales).count() == 0
    assert readers.read_table(spark, folder, "sales", ["orders"]).columns == ["orders"]
    writers.write_csv(sales, folder, "sales_csv")
    back = readers.read_csv_result(spark, folder, "sales_csv", "customer_state string, orders bigint")
    assert back.exceptAll(sales).count() == 0
    one = spark.range(1).select(F.lit(None).cast("int").alias("gap"), F.lit("x").alias("name"))
    writers.write_report(writers.report_row(spark, {"part": one, "rows": writers.nested_rows(sales, "states")}), folder, "report")
    report = readers.read_report(spark, folder, "report").first()
    assert report["part"]["gap"] is None and len(report["rows"]["states"]) == sales.count()


def test_monthly_partitions_keep_types_and_rows(spark, tmp_path, small):
    orders = small.orders("sums")
    stored = writers.write_by_month(orders, str(tmp_path), "orders", "purchase_period", "order_id")
    assert stored.dtypes == orders.dtypes
    assert stored.exceptAll(orders).count() == 0 and stored.count() == orders.count()
    plan = stored.where(F.col("purchase_period") == datetime.datetime(1998, 1, 1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(purchase_period" in plan


def test_columns_are_found_by_header(spark, source):
    (source / "sellers.csv").write_text("extra,seller_state,seller_id,seller_city,seller_zip_code_prefix\nx,SP,s1,sp,1000\n")
    row = readers.read_sources(spark, str(source))["sellers"].first()
    assert row.asDict() == {
        "seller_id": "s1", "seller_zip_code_prefix": 1000, "seller_city": "sp", "seller_state": "SP",
    }
    (source / "sellers.csv").write_text("seller_id,seller_state\ns1,SP\n")
    (source / "category_translation.csv").write_text("product_category_name\nbeleza\n")
    with pytest.raises(ValueError, match="sellers: seller_city, seller_zip_code_prefix; category_translation: product"):
        readers.read_sources(spark, str(source))


def test_a_value_of_the_wrong_type_fails(spark, source):
    header = ",".join(REQUIRED_COLUMNS["sellers"])
    (source / "sellers.csv").write_text(f"{header}\ns1,not a number,sp,SP\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        readers.read_sources(spark, str(source))["sellers"].collect()


def test_parents_load_before_their_children():
    order = writers.load_order(SCHEMAS)
    assert sorted(order) == sorted(SCHEMAS)
    assert all(order.index(parent) < order.index(child) for child, _, parent, _ in FOREIGN_KEYS)


class Recorder:
    """A connection that notes what is run and fails at a statement that contains ``bad``."""

    def __init__(self, bad=None):
        self.done, self.bad = [], bad

    def cursor(self):
        return self

    def execute(self, statement):
        if self.bad and self.bad in statement:
            raise ValueError(statement)
        self.done.append(statement)

    def commit(self):
        self.done.append("COMMIT")

    def rollback(self):
        self.done.append("ROLLBACK")

    def close(self):
        self.done.append("CLOSE")


def test_tables_switch_in_one_transaction():
    connection = Recorder()
    writers.switch(connection, SCHEMAS)
    ran = connection.done[: connection.done.index("COMMIT")]
    emptied = [s.split()[2] for s in ran if s.startswith("DELETE")]
    filled = [s.split()[2] for s in ran if s.startswith("INSERT")]
    assert sorted(emptied) == sorted(filled) == sorted(RELATIONAL_NAMES.values())
    assert ran.index(f"DELETE FROM {emptied[-1]}") < next(k for k, s in enumerate(ran) if s.startswith("INSERT"))
    for child, _, parent, _ in FOREIGN_KEYS:
        c, p = RELATIONAL_NAMES[child], RELATIONAL_NAMES[parent]
        assert emptied.index(c) < emptied.index(p) and filled.index(p) < filled.index(c)
    payments = next(s for s in ran if "INSERT INTO order_payments " in s)
    listed = ", ".join(REQUIRED_COLUMNS["payments"])
    assert payments == f"INSERT INTO order_payments ({listed}) SELECT {listed} FROM order_payments__staging"
    assert connection.done[-2:] == ["COMMIT", "CLOSE"] and sum(s.startswith("DROP") for s in connection.done) == 9


def test_a_failed_switch_rolls_back():
    connection = Recorder("INSERT INTO orders ")
    with pytest.raises(ValueError):
        writers.switch(connection, SCHEMAS)
    assert "COMMIT" not in connection.done and connection.done[-2:] == ["ROLLBACK", "CLOSE"]


def test_relational_projection(spark, source):
    tables = writers.relational_tables(readers.read_sources(spark, str(source)))
    assert set(tables) == set(RELATIONAL_NAMES.values())
    assert tables["order_payments"].columns == REQUIRED_COLUMNS["payments"]


def test_sql_over_registered_views(spark, small):
    assert "order_reviews" in small.register_views()
    text = "SELECT payment_type, count(*) AS payment_records FROM order_payments GROUP BY payment_type"
    from marketgrain.plans.questions import QUESTIONS

    assert spark.sql(text).exceptAll(QUESTIONS["q15"](small.tables).drop("amount_paid")).count() == 0


def test_export_writes_every_row(spark, small, tmp_path):
    path = str(tmp_path / "export")
    orders = small.orders("sums").select("order_id", "merchandise_revenue")
    writers.export_csv(orders, path)
    assert spark.read.csv(path, header=True).count() == orders.count()


def test_popularity_stands_in_for_missing_recommendations(spark):
    from marketgrain.plans.views import recommendations_for

    schema = "source_category string, recommended_category string, co_purchase_orders long, recommendation_strength double"
    popular = spark.createDataFrame([("Art", 5), ("Toys", 3)], "product_category string, orders long")
    none = recommendations_for(spark.createDataFrame([], schema), popular, "Art")
    assert {r["recommended_category"] for r in none.collect()} == {"Art", "Toys"}
    some = spark.createDataFrame([("Toys", "Art", 2, 0.5)], schema)
    assert recommendations_for(some, popular, "Art").count() == 0
    assert recommendations_for(some, popular, "Toys").first()["recommended_category"] == "Art"


def test_whole_job(spark, small, tmp_path):
    output = str(tmp_path)
    options = job.JobOptions(
        cutoff=datetime.datetime(2000, 12, 31),
        horizon_end=datetime.datetime(2001, 6, 30),
        minimum_orders=5,
        delivery=delivery.Settings(forest_trees=3, forest_depth=4),
        segment_restarts=1,
        fatal_keys=("customers", "orders", "products", "sellers", "reviews"),
    )
    published = job.run(spark, small, output, options)
    assert published["order_level"].count() == small.tables["orders"].count()
    assert published["grain_audit"].where("NOT ok").count() == 0
    assert published["business_insights"].count() == 12
    modules = {r["module"] for r in readers.read_table(spark, f"{output}/dashboard", "model_metrics").collect()}
    assert modules == {"Delivery Risk", "Forecasting", "Segmentation", "Retention"}
    assert job.module_metrics(published["model_metrics"], "Forecasting", selected_only=True).count() == 1
    assert "is_complete" in published["monthly_sales"].columns
    report = readers.read_report(spark, f"{output}/reports", "run_results").first()
    assert report["kpis"]["total_delivered_orders"] > 0 and len(report["validation"]["tables"]) == 9
    chosen = job.module_metrics(published["model_metrics"], "Forecasting", selected_only=True).first()
    assert report["forecast"]["selected_model"] == chosen["model"] and report["forecast"]["forecast_months"] == 6
    assert report["forecast"]["training_months"] > report["forecast"]["validation_months"] >= 3
    assert {r["actual"] for r in report["delivery_confusion"]["rows"]} == {"Actual late", "Actual on time"}
    for name in ("delivery_predictions", "customer_segments", "forecast_history", "category_recommendations"):
        assert readers.path_exists(spark, f"{output}/dashboard/{name}")


def test_job_stops_on_a_broken_key(spark, small, tmp_path):
    # items of the sample tables repeat (order_id, order_item_id)
    with pytest.raises(ValueError, match="order_items"):
        job.run(spark, small, str(tmp_path), job.JobOptions())
