"""The marketplace tables as views over a star schema of retail parquet files.

``region nation customer supplier part orders lineitem events`` carry the same relations as a
marketplace export; every view below is a projection, so filters and column pruning reach the files.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketgrain.sources.lazy import LazyTables

# Promised delivery days per order priority.
PROMISE_DAYS = {"1-URGENT": 365, "2-HIGH": 545, "3-MEDIUM": 730, "4-NOT SPECIFIED": 910}
DEFAULT_PROMISE_DAYS = 1095

# A partial dictionary, so that the fallback to the source name runs too.
TRANSLATION = [("ECONOMY", "economy_line"), ("SMALL", "small_line"), ("LARGE", "large_line")]


# Column types of the files, so that opening one starts no job.
FILE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def sample_tables(spark: SparkSession, folder: str) -> Mapping[str, DataFrame]:
    """The nine marketplace tables over ``folder``/<name>.parquet, each opened when first asked for."""

    def read(name: str) -> DataFrame:
        return spark.read.schema(FILE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")

    def nation() -> DataFrame:
        return read("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("state"))

    def translation() -> DataFrame:
        pairs = ", ".join(f"('{source}', '{english}')" for source, english in TRANSLATION)
        names = "product_category_name, product_category_name_english"
        return spark.sql(f"SELECT * FROM VALUES {pairs} AS dictionary({names})")

    return LazyTables(
        {
            "customers": lambda: _customers(read("customer"), nation()),
            "orders": lambda: _orders(read("orders"), read("lineitem")),
            "order_items": lambda: _order_items(read("lineitem")),
            "payments": lambda: _payments(read("lineitem")),
            "reviews": lambda: _reviews(read("events")),
            "products": lambda: _products(read("part")),
            "sellers": lambda: _sellers(read("supplier"), nation()),
            "geolocation": lambda: _geolocation(read("customer")),
            "category_translation": translation,
        }
    )


# The number of each row that decides which of its cells are made unreadable or padded.
_ROW_NUMBERS = {
    "customers": "customer_id",
    "orders": "order_id",
    "order_items": "order_id + order_item_id",
    "payments": "order_id + payment_sequential",
    "reviews": "review_id",
    "products": "product_id",
    "sellers": "seller_id",
    "geolocation": "geolocation_zip_code_prefix",
    "category_translation": "length(product_category_name)",
}


def text_export(tables: Mapping[str, DataFrame]) -> Mapping[str, DataFrame]:
    """The sample tables as a careless text export: dates are text, some unreadable or empty, and some text is padded.

    Of the rows whose number leaves 3 by 7 every date reads "no date", of those that leave 5 by 11 it is empty; rows
    that leave 2 by 5 have white space around every text.
    """

    def exported(name: str) -> DataFrame:
        df, number = tables[name], F.expr(_ROW_NUMBERS[name])
        cells = []
        for field in df.schema.fields:
            cell = F.col(field.name)
            if isinstance(field.dataType, T.TimestampNTZType):
                text = F.date_format(cell, "yyyy-MM-dd HH:mm:ss.SSSSSS")
                cell = F.when(cell.isNull(), None).when(number % 7 == 3, "no date").when(number % 11 == 5, "").otherwise(text)
            elif isinstance(field.dataType, T.StringType):
                cell = F.when(number % 5 == 2, F.concat(F.lit(" \t"), cell, F.lit("\n "))).otherwise(cell)
            cells.append(cell.alias(field.name))
        return df.select(*cells)

    return LazyTables({name: (lambda name=name: exported(name)) for name in _ROW_NUMBERS})


def _customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(nation, customer.c_nationkey == nation.nation).select(
        F.col("c_custkey").alias("customer_id"),
        F.expr("c_custkey div 2").alias("customer_unique_id"),
        F.col("c_nationkey").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("state").alias("customer_state"),
    )


def _orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    shipped = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last_ship"))
    status = (
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .when(F.col("o_orderkey") % 2 == 0, "canceled")
        .otherwise("unavailable")
    )
    promise = F.lit(DEFAULT_PROMISE_DAYS)
    for priority, days in PROMISE_DAYS.items():
        promise = F.when(F.col("o_orderpriority") == priority, days).otherwise(promise)
    return orders.join(shipped, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.when(F.col("last_ship") >= F.col("o_orderdate"), F.col("last_ship")).alias("order_delivered_customer_date"),
        (F.col("o_orderdate") + F.make_dt_interval(days=promise)).alias("order_estimated_delivery_date"),
    )


def _order_items(lineitem: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(12,2)").alias("freight_value"),
    )


def _payments(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.col("l_returnflag").alias("payment_type"),
        F.col("l_quantity").cast("int").alias("payment_installments"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("payment_value"),
    )


def _reviews(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("review_id"),
        F.expr("event_id div 2").alias("order_id"),
        (1 + F.floor("value").cast("int") % 5).cast("int").alias("review_score"),
        F.col("ts").alias("review_creation_date"),
        F.col("ts").alias("review_answer_timestamp"),
    )


def _products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
        F.col("p_brand").alias("product_brand"),
        F.col("p_size").cast("double").alias("product_weight_g"),
    )


def _sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return supplier.join(nation, supplier.s_nationkey == nation.nation).select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").alias("seller_zip_code_prefix"),
        F.col("state").alias("seller_state"),
    )


def _geolocation(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
        (F.col("c_acctbal") / 200 - 34).alias("geolocation_lat"),
        (F.lit(-80) + F.col("c_custkey") % 55).cast("double").alias("geolocation_lng"),
        F.col("c_mktsegment").alias("geolocation_city"),
        (F.col("c_custkey") % 5).cast("string").alias("geolocation_state"),
    )
