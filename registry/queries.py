"""Name to query: each takes a ``Marketplace`` over the sample tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from marketgrain import job
from marketgrain.functions.scalars import risk_band
from marketgrain.ml import delivery, prep, retention, segmentation
from marketgrain.ml import metrics as measures
from marketgrain.operators import quality, ranks
from marketgrain.operators.keys import checked_join, first_per_key
from marketgrain.plans import customer_value as value
from marketgrain.plans import forecast, grains, insights, kpis, marts, recommend, views
from marketgrain.plans.clean import clean_text, parse_dates
from marketgrain.plans.marketplace import Marketplace
from marketgrain.plans.order_level import delivery_slice
from marketgrain.plans.questions import QUESTIONS
from marketgrain.session import pin
from marketgrain.sources.sample_views import text_export
from marketgrain.sources.writers import with_row_keys
from registry.portable import portable

Query = Callable[[Marketplace], DataFrame]

QUERIES: dict[str, Query] = {
    name: (lambda m, question=question: question(m.tables)) for name, question in QUESTIONS.items()
}


def named(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(QUERIES[name](Marketplace.from_samples(spark, sf_dir)))

    return run


# ---- data quality -------------------------------------------------------------------------------


@named
def key_findings(m):
    return quality.key_findings(m.tables)


@named
def candidate_keys(m):
    return quality.candidate_keys(m.tables)


@named
def join_multiplication(m):
    """All joins of the order table and its parts, and those that would multiply rows without a fold."""
    t = m.tables
    key = {"customer": "customer_zip_code_prefix", "seller": "seller_zip_code_prefix"}
    zips = {role: m.zip_summary.select(F.col("geolocation_zip_code_prefix").alias(c)) for role, c in key.items()}
    folds = grains.item_folds(t["order_items"])
    joins = [
        ("orders to customers", t["orders"], t["customers"], "customer_id"),
        ("items to products", t["order_items"], t["products"], "product_id"),
        ("items to sellers", t["order_items"], t["sellers"], "seller_id"),
        ("item folds to products", folds, t["products"], "product_id"),
        ("orders to items", t["orders"], t["order_items"], "order_id"),
        ("orders to payments", t["orders"], t["payments"], "order_id"),
        ("orders to reviews", t["orders"], t["reviews"], "order_id"),
        ("orders to items per order", t["orders"], m.items_per_order, "order_id"),
        ("orders to payments per order", t["orders"], m.payments_per_order, "order_id"),
        ("orders to reviews per order", t["orders"], m.reviews_per_order, "order_id"),
        ("customers to zip summary", t["customers"], zips["customer"], key["customer"]),
        ("sellers to zip summary", t["sellers"], zips["seller"], key["seller"]),
        ("products to category names", t["products"], t["category_translation"], "product_category_name"),
    ]
    return quality.union_all(quality.join_multiplication(name, left, right, [c]) for name, left, right, c in joins)


@named
def checked_order_customers(m):
    return checked_join(
        m.tables["orders"].select("order_id", "customer_id"),
        m.tables["customers"].select("customer_id", "customer_unique_id", "customer_state"),
        "customer_id",
        name="customers",
    )


@named
def validation_report(m):
    return quality.validation_report(m.tables).drop("expected_rows", "row_count_matches")


@named
def identity_report(m):
    return quality.identity_report(m.tables)


@named
def grain_audit(m):
    return quality.grain_audit(
        m.tables,
        m.orders("customers", "sums", "payments", "reviews"),
        m.customer_features,
        m.zip_summary,
        m.items_per_order,
        m.payments_per_order,
    )


@named
def range_findings(m):
    return quality.range_findings(m.tables)


@named
def foreign_key_findings(m):
    return quality.foreign_key_findings(m.tables)


@named
def null_findings(m):
    return quality.null_findings(m.tables)


def _exported(m):
    """All nine tables as a text export with unreadable dates and padded text."""
    tables = {**m.tables, "products": m.tables["products"].select("product_id", "product_category_name", "product_brand", "product_weight_g")}
    return text_export(tables)


def _texts(tables):
    """The text columns that are no dates."""
    return {n: [c for c in quality.text_columns(df) if c not in quality.date_columns(df)] for n, df in tables.items()}


@named
def column_profile(m):
    return quality.schema_profile(_exported(m))


@named
def date_profile(m):
    return quality.schema_dates(_exported(m))


@named
def numeric_profile(m):
    return quality.schema_numbers(_exported(m))


@named
def top_values(m):
    tables = _exported(m)
    return quality.schema_top_values(tables, _texts(tables))


# ---- cleaning -----------------------------------------------------------------------------------


@named
def clean_text_tables(m):
    """Every text of every table after cleaning, counted."""
    tables = _exported(m)
    return quality.schema_frequencies({n: clean_text(df) for n, df in tables.items()}, _texts(tables))


QUERIES["clean_text"] = QUERIES.pop("clean_text_tables")


@named
def parsed_dates(m):
    """Every date of every table after parsing, counted; unreadable ones are unknown."""
    tables = {n: parse_dates(n, df) for n, df in _exported(m).items()}
    columns = {n: [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"] for n, df in tables.items()}
    counted = quality.schema_frequencies(tables, columns)
    return counted.select("table_name", "column_name", F.expr("cast(value AS timestamp_ntz)").alias("moment"), "copies")


@named
def clean_products(m):
    return m.tables["products"].select("product_id", "product_category_name", "product_category", "product_weight_g")


# ---- grains -------------------------------------------------------------------------------------


@named
def zip_summary(m):
    return m.zip_summary


@named
def customers_geo(m):
    return m.customers_geo


@named
def sellers_geo(m):
    return m.sellers_geo


@named
def enriched_items(m):
    return m.enriched_items


@named
def items_per_order(m):
    return m.items_per_order


@named
def payments_per_order(m):
    return m.payments_per_order


@named
def reviews_per_order(m):
    return m.reviews_per_order


@named
def order_context(m):
    return m.order_context


@named
def order_level(m):
    return m.order_level


@named
def delivery_slice_table(m):
    return delivery_slice(m.order_level)


QUERIES["delivery_slice"] = QUERIES.pop("delivery_slice_table")


@named
def haversine_km(m):
    """Distance per order between customer and main seller."""
    return m.order_level.select("order_id", "distance_km")


@named
def review_row_keys(m):
    """Dense keys of all reviews in the order of their answers."""
    reviews = m.tables["reviews"].select("review_answer_timestamp", "review_id", "order_id")
    return with_row_keys(reviews, ["review_answer_timestamp", "review_id"])


@named
def first_per_key_items(m):
    """The cheapest item of every seller."""
    order = ["price", "order_id", "order_item_id", "product_id", "shipping_limit_date"]
    return first_per_key(m.tables["order_items"], ["seller_id"], [F.asc(c) for c in order])


QUERIES["first_per_key"] = QUERIES.pop("first_per_key_items")


# ---- marts --------------------------------------------------------------------------------------


@named
def customer_features(m):
    return m.customer_features


@named
def monthly_sales(m):
    return marts.monthly_sales(m.orders("customers", "sums"))


@named
def category_summary(m):
    return marts.category_summary(m.items, m.orders("reviews"))


@named
def seller_summary(m):
    return marts.seller_summary(m.items, m.orders("customers", "reviews"), m.tables["sellers"])


@named
def cohort_retention(m):
    return marts.cohort_retention(m.orders("customers"))


@named
def cohort_matrix(m):
    return marts.cohort_matrix(marts.cohort_retention(m.orders("customers")), minimum_size=5)


@named
def state_sales(m):
    return marts.state_sales(m.orders("customers", "sums"))


@named
def payment_summary(m):
    return marts.payment_summary(m.orders("payments"))


@named
def customer_state_summary(m):
    return marts.customer_state_summary(m.customer_features)


@named
def delivery_state_summary(m):
    return marts.delivery_state_summary(m.orders("customers", "sums", "reviews"))


@named
def review_distribution(m):
    return marts.review_distribution(m.orders("reviews"))


@named
def delay_review(m):
    return marts.delay_review_summary(m.orders("reviews"))


@named
def orders_by_month(m):
    return marts.orders_by_month(m.orders())


@named
def late_review_counts(m):
    return marts.late_review_counts(m.orders("reviews"))


@named
def kpi_row(m):
    orders = m.orders("customers", "sums", "reviews")
    return kpis.kpi_row(orders, kpis.customer_repeats(orders))


@named
def customer_value(m):
    tiers = value.customer_value(m.customer_features)
    return tiers.select("customer_unique_id", "total_spend", "historical_customer_value", "value_tier")


@named
def spend_percent_rank(m):
    return ranks.average_percent_rank(m.customer_features, "total_spend")


@named
def seller_state_shares(m):
    """Share and running share of the sellers of each state; many states have equally many."""
    sellers = m.tables["sellers"].groupBy("seller_state").agg(F.count(F.lit(1)).alias("sellers"))
    return ranks.running_shares(sellers, "sellers")


@named
def exact_quantiles(m):
    """Quartiles and tails of the item price per seller state."""
    items = checked_join(m.tables["order_items"], m.tables["sellers"], "seller_id", name="sellers")
    return ranks.exact_quantiles(items, "price", [0.01, 0.25, 0.5, 0.75, 0.99], ["seller_state"])


def _brands(m):
    """Items under the product's brand instead of its category: brands are many, categories few."""
    brands = m.tables["products"].select("product_id", F.col("product_brand").alias("product_category"))
    return checked_join(m.tables["order_items"], brands, "product_id", name="products")


@named
def order_categories(m):
    return recommend.order_categories(m.items, m.orders())


@named
def recommendations(m):
    return recommend.recommendations(recommend.order_categories(_brands(m), m.orders()))


@named
def popularity(m):
    return recommend.popularity(recommend.order_categories(_brands(m), m.orders()))


@named
def recommendations_for(m):
    held = recommend.order_categories(_brands(m), m.orders())
    return views.recommendations_for(recommend.recommendations(held), recommend.popularity(held), "Brand#3")


# ---- findings -----------------------------------------------------------------------------------


@named
def business_insights(m):
    # every finding reads the orders, so they are stored once as the job stores them
    orders = pin(m.orders("customers", "sums", "payments", "reviews"))
    repeats = kpis.customer_repeats(orders)
    monthly = forecast.mark_complete(marts.monthly_sales(orders))
    return insights.business_insights(
        kpis.kpi_row(orders, repeats),
        orders,
        repeats,
        monthly.where("is_complete"),
        marts.category_summary(m.items, orders),
        marts.seller_summary(m.items, orders, m.tables["sellers"]),
        marts.state_sales(orders),
        marts.payment_summary(orders),
        marts.delay_review_summary(orders),
    )


QUERIES["insights"] = QUERIES.pop("business_insights")

SLICE = {
    "start": datetime.date(1996, 1, 1),
    "end": datetime.date(1999, 12, 31),
    "states": ["NATION_1", "NATION_4", "NATION_7", "NATION_11"],
    "categories": ["Economy Line", "Promo", "Small Line"],
}


def _slice(m, *parts):
    return views.slice_orders(m.orders("customers", "sums", "context", *parts), **SLICE)


@named
def order_slice(m):
    return _slice(m).select(
        "order_id", "order_purchase_timestamp", "customer_state", "product_category", "merchandise_revenue"
    )


@named
def filtered_insights(m):
    return insights.slice_insights(_slice(m, "payments", "reviews"))


@named
def filter_values(m):
    return views.filter_values(m.orders("customers", "context"))


@named
def overview_measures(m):
    return views.overview_measures(_slice(m))


@named
def overview_monthly(m):
    return views.overview_monthly(_slice(m))


@named
def overview_categories(m):
    return views.overview_categories(m.orders("sums", "context"))


@named
def overview_states(m):
    return views.overview_states(m.orders("customers", "sums"))


def _complete_monthly(m):
    return forecast.mark_complete(marts.monthly_sales(m.orders("customers", "sums")))


@named
def sales_headline(m):
    return views.sales_headline(_complete_monthly(m))


@named
def growth_months(m):
    return views.growth_months(_complete_monthly(m))


@named
def sales_top_states(m):
    return views.top_rows(marts.state_sales(m.orders("customers", "sums")), "merchandise_revenue", 12, "customer_state")


@named
def customer_headline(m):
    return kpis.customer_headline(m.customer_features)


@named
def customer_top_states(m):
    return views.top_rows(marts.customer_state_summary(m.customer_features), "customers", 15, "customer_state")


@named
def purchase_frequency(m):
    return views.purchase_frequency(m.customer_features)


@named
def spend_histogram(m):
    return views.histogram(m.customer_features, ["total_spend"])


@named
def recency_histogram(m):
    return views.histogram(m.customer_features, ["recency"])


@named
def rfm_histogram(m):
    buyers = m.customer_features.where(F.col("delivered_orders") > 0)
    return views.histogram(buyers, ["recency", "frequency", "monetary"], bins=40)


@named
def rfm_base(m):
    rfm = _rfm(m)
    return rfm.select("*", *[F.log1p(F.col(c).cast("double")).alias(f"log_{c}") for c in ("recency", "frequency", "monetary")])


def _rfm(m):
    return segmentation.rfm_base(m.customer_features)


@named
def top_categories(m):
    return views.top_rows(QUERIES["category_summary"](m), "merchandise_revenue", 10, "product_category")


@named
def top_sellers(m):
    return views.top_rows(QUERIES["seller_summary"](m), "merchandise_revenue", 10, "seller_id", "seller_state")


@named
def product_headline(m):
    return views.product_headline(QUERIES["category_summary"](m))


@named
def delivery_headline(m):
    return views.delivery_headline(m.orders("sums", "reviews"))


@named
def slow_states(m):
    return views.slow_states(QUERIES["delivery_state_summary"](m))


@named
def late_states(m):
    return views.slow_states(QUERIES["delivery_state_summary"](m), "late_delivery_rate")


@named
def seller_scorecard(m):
    return views.seller_scorecard(QUERIES["seller_summary"](m))


# ---- forecasts ----------------------------------------------------------------------------------

SERIES = "customer_state"
# a state sees fewer orders a month than the whole marketplace
SERIES_MINIMUM_ORDERS = 2


def _series_months(m):
    monthly = marts.monthly_sales(m.orders("customers", "sums"), SERIES)
    return forecast.complete_months(monthly, SERIES, SERIES_MINIMUM_ORDERS)


@named
def complete_months(m):
    whole = marts.monthly_sales(m.orders("customers", "sums")).withColumn(SERIES, F.lit("all"))
    flagged = forecast.complete_months(whole, SERIES).unionByName(_series_months(m))
    return flagged.select(SERIES, "purchase_period", "all_orders", "position", "is_complete", "cutoff")


@named
def forecast_validation(m):
    months = forecast.split_months(_series_months(m), SERIES)
    return forecast.naive_predictions(months, SERIES)


@named
def forecast_metrics(m):
    months = forecast.split_months(_series_months(m), SERIES)
    return forecast.forecast_metrics(forecast.naive_predictions(months, SERIES), [SERIES, "model"])


@named
def forecast_future(m):
    return forecast.naive_future(forecast.split_months(_series_months(m), SERIES), SERIES)


@named
def trend_forecast(m):
    return forecast.trend_predictions(forecast.split_months(_series_months(m), SERIES), SERIES)


def _history(m):
    monthly = marts.monthly_sales(m.orders("customers", "sums"), SERIES)
    return forecast.forecast_history(monthly, SERIES, SERIES_MINIMUM_ORDERS)


@named
def forecast_lines(m):
    return views.forecast_lines(_history(m), SERIES)


@named
def forecast_history(m):
    return _history(m)


# ---- models -------------------------------------------------------------------------------------


def _lateness(m):
    """Delivered orders with a probability that any engine can compute: a short promise is a risk."""
    known = m.orders().where((F.col("order_status") == "delivered") & F.col("late_delivery").isNotNull())
    probability = (F.lit(1300.0) - F.col("estimated_delivery_days") + F.col("purchase_month")) / 1300.0
    return known.select(
        "order_id", "order_purchase_timestamp", "late_delivery", probability.alias("late_delivery_probability")
    )


@named
def delivery_training_set(m):
    return delivery.training_set(m.order_level)


@named
def imputed_features(m):
    """The delivery features as the models' scaling and encoding take them: medians, usual and shared levels."""
    # read for the boundary, the medians, the levels and the rows: written once, without the joins behind it
    split = delivery.chronological_split(pin(delivery.training_set(m.order_level)))
    training = split.where(F.col("evaluation_split") == "Training")
    rows = prep.imputed(training, split, delivery.NUMERIC, delivery.CATEGORICAL)
    numbers = [F.col(f"{c}__number").alias(c) for c in delivery.NUMERIC]
    return rows.select("order_id", *numbers, *[F.col(c).alias(c.removesuffix("__level")) for c in prep.level_names(delivery.CATEGORICAL)])


@named
def selected_model(m):
    """The candidate chosen among given scores: the promise alone, the promise and month, and one for all."""
    known = _lateness(m)
    p = F.col("late_delivery_probability")
    candidates = {"Promise": F.round(p, 1), "Promise and month": p, "Constant": F.lit(0.75)}
    scored = quality.union_all(
        known.select(F.lit(name).alias("model"), "late_delivery", of.alias("late_delivery_probability")) for name, of in candidates.items()
    )
    compared = measures.classification_metrics(scored, "late_delivery", "late_delivery_probability", ["model"])
    return delivery.best_model(compared)


@named
def chronological_split(m):
    return delivery.chronological_split(_lateness(m)).select("order_id", "order_purchase_timestamp", "evaluation_split")


@named
def prior_baseline(m):
    return delivery.prior_baseline(delivery.chronological_split(_lateness(m)))


@named
def class_weights(m):
    return measures.class_weights(_lateness(m), "late_delivery")


@named
def classification_metrics(m):
    return measures.classification_metrics(_lateness(m), "late_delivery", "late_delivery_probability")


@named
def confusion_matrix(m):
    matrix = measures.confusion_matrix(_lateness(m), "late_delivery", "late_delivery_probability")
    return matrix.toDF("actual", "predicted_on_time", "predicted_late")


@named
def roc_curve(m):
    curve = measures.roc_curve(_lateness(m), "late_delivery", "late_delivery_probability")
    return curve.withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))


@named
def pr_curve(m):
    return measures.pr_curve(_lateness(m), "late_delivery", "late_delivery_probability")


@named
def risk_bands(m):
    band = risk_band(F.col("late_delivery_probability")).alias("risk_category")
    return _lateness(m).groupBy(band).agg(F.count(F.lit(1)).alias("orders"))


@named
def risk_histogram(m):
    banded = _lateness(m).withColumn("risk_category", risk_band(F.col("late_delivery_probability")))
    return views.histogram(banded, ["late_delivery_probability"], bins=40, cap=None, by="risk_category")


CUTOFF, HORIZON_END = datetime.datetime(2000, 12, 31), datetime.datetime(2001, 6, 30)


@named
def retention_dataset(m):
    return retention.retention_dataset(m.orders("customers", "sums", "reviews"), CUTOFF, HORIZON_END)


@named
def retention_known_at_cutoff(m):
    return retention.retention_dataset(m.orders("customers", "sums", "reviews"), CUTOFF, HORIZON_END, True)


@named
def retention_split(m):
    """The stratified split of the retention customers by a hash that any engine computes alike."""
    split = retention.stratified_split(QUERIES["retention_dataset"](m))
    return split.select("customer_unique_id", "target", "split")


@named
def retention_gate(m):
    return retention.feasibility(QUERIES["retention_dataset"](m))


@named
def retention_scores(m):
    """The gate is lowered to the size of the sample tables."""
    return retention.train(m.orders("customers", "sums", "reviews"), CUTOFF, HORIZON_END, 5, 0.005, 5).predictions


def _clusters(m):
    """Clusters that any engine can form."""
    return _rfm(m).select("*", (F.col("customer_unique_id") % 4).cast("int").alias("cluster"))


@named
def segment_naming(m):
    """Profiles and names of given clusters."""
    return segmentation.segment_profiles(_clusters(m))


def _segments(m):
    return segmentation.named_segments(m.customer_features, _clusters(m), QUERIES["segment_naming"](m))


@named
def named_segments(m):
    """Every customer's segment for given clusters; without a delivered order there is none."""
    return _segments(m).select("customer_unique_id", "cluster", "segment")


@named
def segment_counts(m):
    return segmentation.segment_counts(_segments(m))


@named
def segment_means(m):
    return segmentation.segment_means(_segments(m))


@named
def largest_segment(m):
    return segmentation.largest_segment(QUERIES["segment_naming"](m))


@named
def segment_interpretations(m):
    return segmentation.interpretations(QUERIES["segment_naming"](m))


@named
def silhouette(m):
    """Silhouette of all customers for clusters that any engine can form."""
    points = _rfm(m).select(
        *[F.log1p(F.col(c).cast("double")).alias(c) for c in segmentation.RFM],
        (F.col("customer_unique_id") % 4).cast("int").alias("silhouette"),
    )
    return segmentation.silhouettes(points, segmentation.RFM, ["silhouette"])


@named
def segments(m):
    result = segmentation.train(m.customer_features)
    return result.segments.select("customer_unique_id", "recency", "frequency", "monetary", "cluster", "segment")


@named
def segment_summary(m):
    return segmentation.train(m.customer_features).profiles


@named
def delivery_scores(m):
    return delivery.train(m.order_level).predictions


@named
def feature_importance(m):
    return delivery.readable_importance(delivery.train(m.order_level).importance)


@named
def model_metrics(m):
    """Metrics of all model families in one table."""
    return job.model_metrics(
        delivery.train(m.order_level).metrics,
        forecast.compare_models(
            forecast.validation_predictions(
                forecast.split_months(
                    forecast.complete_months(
                        marts.monthly_sales(m.orders("customers", "sums")).withColumn("series", F.lit("all")), "series"
                    ),
                    "series",
                ),
                "series",
            ),
            "series",
        ).drop("series"),
        segmentation.train(m.customer_features).metrics,
        retention.train(m.orders("customers", "sums", "reviews"), CUTOFF, HORIZON_END, 5, 0.005, 5).metrics,
    )
