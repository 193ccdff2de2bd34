"""Every one-to-many table reduced to one row per order (or per ZIP) before any join.

Each reduction is a grouped aggregate with map-side partials, so an order that holds a large share of
the rows is folded before it is shuffled, and its result is unique on the key by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from marketgrain.operators.keys import checked_join, first_per_key, not_null
from marketgrain.operators.ranks import exact_quantiles

# The box of plausible coordinates, both ends included.
LATITUDE_BOUNDS = (-34.0, 6.0)
LONGITUDE_BOUNDS = (-75.0, -30.0)


def zip_summary(geolocation: DataFrame) -> DataFrame:
    """One row per ZIP: median of the plausible coordinates, observation count, most frequent place."""
    zip_code, lat, lng = F.col("geolocation_zip_code_prefix"), F.col("geolocation_lat"), F.col("geolocation_lng")
    inside = lat.between(*LATITUDE_BOUNDS) & lng.between(*LONGITUDE_BOUNDS)
    known = not_null(geolocation, "geolocation_zip_code_prefix")
    axes = (
        known.where(inside)
        .select(zip_code, F.explode(F.create_map(F.lit("lat"), lat, F.lit("lng"), lng)).alias("axis", "degrees"))
    )
    medians = (
        exact_quantiles(axes, "degrees", [0.5], ["geolocation_zip_code_prefix", "axis"])
        .groupBy("geolocation_zip_code_prefix")
        .agg(
            F.max(F.when(F.col("axis") == "lat", F.col("quantile"))).alias("geolocation_lat"),
            F.max(F.when(F.col("axis") == "lng", F.col("quantile"))).alias("geolocation_lng"),
        )
    )
    places = known.groupBy("geolocation_zip_code_prefix", "geolocation_state", "geolocation_city").agg(
        F.count(F.lit(1)).alias("seen")
    )
    state, city = F.col("geolocation_state"), F.col("geolocation_city")
    # the most frequent (state, city) pair, not two separate modes; unknown names come last on ties
    frequency = F.struct(-F.col("seen"), state.isNull(), state, city.isNull(), city)
    summary = places.groupBy("geolocation_zip_code_prefix").agg(
        F.sum("seen").alias("geolocation_source_rows"),
        F.min_by(F.struct(state, city), frequency).alias("place"),
    )
    return summary.join(medians, "geolocation_zip_code_prefix", "left").select(
        "geolocation_zip_code_prefix",
        "geolocation_lat",
        "geolocation_lng",
        "geolocation_source_rows",
        "place.*",
    )


def _located(df: DataFrame, zips: DataFrame, role: str, place_prefix: str) -> DataFrame:
    roles = zips.select(
        F.col("geolocation_zip_code_prefix").alias(f"{role}_zip_code_prefix"),
        F.col("geolocation_lat").alias(f"{role}_lat"),
        F.col("geolocation_lng").alias(f"{role}_lng"),
        F.col("geolocation_city").alias(f"{place_prefix}_city"),
        F.col("geolocation_state").alias(f"{place_prefix}_state"),
    )
    # zip_summary has one row per ZIP by construction
    return df.join(roles, f"{role}_zip_code_prefix", "left")


def customers_geo(customers: DataFrame, zips: DataFrame) -> DataFrame:
    return _located(customers, zips, "customer", "zip")


def sellers_geo(sellers: DataFrame, zips: DataFrame) -> DataFrame:
    return _located(sellers, zips, "seller", "seller_zip")


def categorised_items(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Order items (or their folds) with category and weight; still one row per item."""
    product = products.select("product_id", "product_category", "product_weight_g")
    joined = checked_join(order_items, product, "product_id", name="products")
    return joined.withColumn("product_category", F.coalesce("product_category", F.lit("Unknown")))


def enriched_items(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Categorised items with the seller's state and coordinates; still one row per item."""
    seller = sellers.select("seller_id", "seller_state", "seller_lat", "seller_lng")
    return checked_join(items, seller, "seller_id", name="sellers")


#: Distance between two line values in ``_line_rank``; above all item numbers.
_ITEM_NUMBERS = 1 << 33


def _line_rank() -> Column:
    """The place of an item in its order as one fixed-width number, which hash aggregation can fold.

    The most valuable line comes first, an unknown value last; the smaller item number decides ties.
    """
    cents = ((F.col("price") + F.col("freight_value")) * 100).cast("decimal(20,0)")
    value = F.coalesce(-cents, F.lit("9" * 21).cast("decimal(21,0)")).cast("decimal(28,0)")
    number = F.coalesce(F.col("order_item_id").cast("bigint") + (1 << 32), F.lit(0)).cast("decimal(10,0)")
    return (value * F.lit(_ITEM_NUMBERS).cast("decimal(10,0)") + number).cast("decimal(38,0)")


def item_folds(order_items: DataFrame) -> DataFrame:
    """One mergeable row per (order, product, seller): count, sums and the rank of the best line.

    Everything an order needs of its items derives from these rows, so the items are read and shuffled once.
    Category and weight of categorised items are kept.
    """
    named = [c for c in ("product_category", "product_weight_g") if c in order_items.columns]
    return not_null(order_items, "order_id").groupBy("order_id", "product_id", "seller_id", *named).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("price").cast("decimal(22,2)").alias("merchandise_revenue"),
        F.sum("freight_value").cast("decimal(22,2)").alias("total_freight_value"),
        F.min(_line_rank()).alias("best_line"),
    )


def categorised_folds(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """The folds of the items with category and weight, looked up per fold and not per item."""
    return categorised_items(item_folds(order_items), products)


def _money_sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("decimal(22,2)").alias(column)


def _counts() -> list[Column]:
    return [
        F.sum("item_count").alias("item_count"),
        F.count_distinct("product_id").alias("unique_product_count"),
        F.count_distinct("seller_id").alias("unique_seller_count"),
        _money_sum("merchandise_revenue"),
        _money_sum("total_freight_value"),
    ]


def _mean_weight() -> Column:
    weighed = F.when(F.col("product_weight_g").isNotNull(), F.col("item_count"))
    mean = F.sum(F.col("product_weight_g") * F.col("item_count")) / F.sum(weighed)
    return mean.alias("average_product_weight_g")


def _with_best_line(folds: DataFrame, per_order: DataFrame) -> DataFrame:
    """``per_order`` (with ``best_line``) and the category and seller of that line.

    The rank was folded by hash; only the folds that reach it are looked at, and equal ones are told apart by
    product and seller. The join key holds the rank, so the folds of a hot order spread over tasks.
    """
    lines = folds.select("order_id", "best_line", "product_id", "seller_id", "product_category")
    reached = per_order.join(lines, ["order_id", "best_line"])
    return first_per_key(reached, ["order_id"], [F.asc("product_id"), F.asc("seller_id")]).drop("best_line", "product_id")


def _with_place(per_order: DataFrame, sellers: DataFrame) -> DataFrame:
    """The seller's place, looked up for the one chosen line of an order, not for every item."""
    place = [c for c in ("seller_state", "seller_lat", "seller_lng") if c in sellers.columns]
    located = checked_join(per_order, sellers.select("seller_id", *place), "seller_id", name="sellers")
    return located.drop("seller_id")


def items_per_order(order_items: DataFrame) -> DataFrame:
    """Counts and sums per order."""
    return item_folds(order_items).groupBy("order_id").agg(*_counts())


def _first_of(column: str) -> Column:
    """1 on the first line of every known value of ``column`` inside its order, else null."""
    before = F.lag(column).over(Window.partitionBy("order_id").orderBy(column))
    return F.when(F.col(column).isNotNull() & ~before.eqNullSafe(F.col(column)), 1)


def order_facts(order_items: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """``items_per_order`` and ``order_context`` in one row per order.

    The items travel twice, as narrow rows: to their products and from there to their orders. Everything after that
    happens where the order lies; only the row of an order goes on to the seller. ``sellers`` may come without
    coordinates when the caller does not need them.
    """
    narrow = not_null(order_items, "order_id").select(
        "order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"
    )
    lines = categorised_items(narrow, products).repartition("order_id")
    lines = lines.withColumns({"item_count": F.lit(1).cast("bigint"), "__product": _first_of("product_id")})
    lines = lines.withColumn("__seller", _first_of("seller_id"))
    per_order = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count("__product").alias("unique_product_count"),
        F.count("__seller").alias("unique_seller_count"),
        F.coalesce(F.sum("price"), F.lit(0)).cast("decimal(22,2)").alias("merchandise_revenue"),
        F.coalesce(F.sum("freight_value"), F.lit(0)).cast("decimal(22,2)").alias("total_freight_value"),
        _mean_weight(),
        F.min(F.struct(_line_rank().alias("rank"), "product_id", "seller_id", "product_category")).alias("__best"),
    )
    best = [F.col(f"__best.{c}").alias(c) for c in ("seller_id", "product_category")]
    return _with_place(per_order.select("*", *best).drop("__best"), sellers)


def _sums(grouped: GroupedData, price: Column, freight: Column) -> DataFrame:
    return grouped.agg(
        F.count(F.lit(1)).alias("item_count"),
        F.coalesce(F.sum(price), F.lit(0)).cast("decimal(22,2)").alias("merchandise_revenue"),
        F.coalesce(F.sum(freight), F.lit(0)).cast("decimal(22,2)").alias("total_freight_value"),
    )


def order_sums(order_items: DataFrame) -> DataFrame:
    """``items_per_order`` without the distinct counts, for marts that need only the sums."""
    return _sums(not_null(order_items, "order_id").groupBy("order_id"), F.col("price"), F.col("freight_value"))


def payments_per_order(payments: DataFrame) -> DataFrame:
    """Totals per order and the type that carries the largest summed value (ties by name).

    The order level reads the (order, type) level, so the type count is a plain count. The payments travel once, to
    their orders: both levels are formed there.
    """
    per_type = (
        not_null(payments, "order_id")
        .select("order_id", "payment_type", "payment_value", "payment_installments")
        .repartition("order_id")
        .groupBy("order_id", "payment_type")
        .agg(
            F.coalesce(F.sum("payment_value"), F.lit(0)).cast("decimal(22,2)").alias("value"),
            F.count(F.lit(1)).alias("records"),
            F.max("payment_installments").alias("installments"),
        )
    )
    by_value = F.when(F.col("payment_type").isNotNull(), F.struct(-F.col("value"), F.col("payment_type")))
    return per_type.groupBy("order_id").agg(
        F.sum("value").cast("decimal(22,2)").alias("total_payment_value"),
        F.sum("records").alias("payment_record_count"),
        F.count("payment_type").alias("payment_type_count"),
        F.max("installments").alias("maximum_installments"),
        F.min_by("payment_type", by_value).alias("dominant_payment_type"),
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    """Mean score and count per order, plus the latest review; an unknown answer time counts as latest."""
    answered, review = F.col("review_answer_timestamp"), F.col("review_id")
    latest = F.max_by(
        F.struct("review_id", "review_score", "review_creation_date", "review_answer_timestamp"),
        F.struct(answered.isNull(), answered, review.isNull(), review),
    )
    return (
        not_null(reviews, "order_id")
        .groupBy("order_id")
        .agg(
            F.avg("review_score").alias("average_review_score"),
            F.count(F.lit(1)).alias("review_count"),
            latest.alias("latest"),
        )
        .select("order_id", "average_review_score", "review_count", "latest.*")
    )


def order_context(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Category and seller place of the order's most valuable item, and the mean product weight.

    ``items`` are categorised items or their folds. ``sellers`` may come without coordinates.
    """
    folds = items if "best_line" in items.columns else item_folds(items)
    per_order = folds.groupBy("order_id").agg(_mean_weight(), F.min("best_line").alias("best_line"))
    located = _with_place(_with_best_line(folds, per_order), sellers)
    place = [c for c in ("seller_state", "seller_lat", "seller_lng") if c in located.columns]
    return located.select("order_id", "product_category", *place, "average_product_weight_g")
