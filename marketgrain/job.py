"""The whole job: read, check, clean, reduce, join, audit, derive, train, publish, report.

    spark-submit marketgrain_job.py SOURCE_FOLDER OUTPUT_FOLDER [--jdbc-url URL]
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.ml import delivery, retention, segmentation
from marketgrain.operators import quality
from marketgrain.operators.keys import verified_keys
from marketgrain.plans import customer_value, forecast, insights, kpis, marts, recommend
from marketgrain.plans.marketplace import Marketplace
from marketgrain.plans.order_level import delivery_slice
from marketgrain.sources import writers

SERIES = "series"


@dataclass
class JobOptions:
    """What a run can vary; the defaults are the published run."""

    cutoff: datetime.datetime = retention.CUTOFF
    horizon_end: datetime.datetime = retention.HORIZON_END
    minimum_orders: int = forecast.MINIMUM_ORDERS
    delivery: delivery.Settings = field(default_factory=delivery.Settings)
    segment_restarts: int = segmentation.RESTARTS
    check_keys: bool = True
    # item keys known to repeat in the source are reported, not fatal
    fatal_keys: tuple[str, ...] = tuple(quality.UNIQUE_KEYS)
    expected_rows: Mapping[str, int] = field(default_factory=dict)
    jdbc_url: str | None = None
    jdbc_properties: Mapping[str, str] = field(default_factory=dict)


def model_metrics(
    delivery_metrics: DataFrame, forecast_metrics: DataFrame, segment_metrics: DataFrame, retention_metrics: DataFrame
) -> DataFrame:
    """Metrics of all model families under their module name; a measure a family lacks is null."""
    modules = {
        "Delivery Risk": delivery_metrics,
        "Forecasting": forecast_metrics,
        "Segmentation": segment_metrics,
        "Retention": retention_metrics,
    }
    tagged = [df.select(F.lit(name).alias("module"), "*") for name, df in modules.items()]
    return quality.union_all(tagged, allow_missing=True)


def module_metrics(metrics: DataFrame, module: str, selected_only: bool = False) -> DataFrame:
    """The rows of one family, or only its selected model."""
    rows = metrics.where(F.col("module") == module)
    return rows.where("selected") if selected_only else rows


def publish_core(m: Marketplace, folder: str) -> Marketplace:
    """Write the seven core tables, each once, and continue from the stored copies."""
    m = m.with_published(geolocation_zip_summary=writers.write_table(m.zip_summary, folder, "geolocation_zip_summary"))
    per_order = {
        "seller_order_items": lambda: m.enriched_items,
        "order_items_order_level": lambda: m.items_per_order,
        "payments_order_level": lambda: m.payments_per_order,
        "reviews_order_level": lambda: m.reviews_per_order,
    }
    for name, build in per_order.items():
        m = m.with_published(**{name: writers.write_table(build(), folder, name)})
    order_level = writers.write_by_month(m.order_level, folder, "order_level", "purchase_period", "order_id")
    m = m.with_published(order_level=order_level)
    return m.with_published(customer_level=writers.write_table(m.customer_features, folder, "customer_level"))


def dashboard_tables(m: Marketplace, minimum_orders: int = forecast.MINIMUM_ORDERS) -> dict[str, Callable[[], DataFrame]]:
    """Every mart by name, over the stored core tables."""
    orders, items, customers = m.order_level, m.items, m.customer_features
    held = recommend.order_categories(items, orders)
    monthly = marts.monthly_sales(orders)
    return {
        "overview": lambda: orders,
        "monthly_sales": lambda: forecast.mark_complete(monthly, minimum_orders),
        "customer_features": lambda: customer_value.customer_value(customers),
        "delivery_analysis": lambda: delivery_slice(orders),
        "cohort_retention": lambda: marts.cohort_retention(orders),
        "forecast_history": lambda: forecast.forecast_history(
            monthly.withColumn(SERIES, F.lit("all")), SERIES, minimum_orders
        ).drop(SERIES),
        "product_summary": lambda: marts.category_summary(items, orders),
        "seller_summary": lambda: marts.seller_summary(items, orders, m.tables["sellers"]),
        "state_sales": lambda: marts.state_sales(orders),
        "customer_state_summary": lambda: marts.customer_state_summary(customers),
        "delivery_state_summary": lambda: marts.delivery_state_summary(orders),
        "payment_summary": lambda: marts.payment_summary(orders),
        "review_distribution": lambda: marts.review_distribution(orders),
        "delay_review_summary": lambda: marts.delay_review_summary(orders),
        "category_recommendations": lambda: recommend.recommendations(held),
        "category_popularity": lambda: recommend.popularity(held),
    }


def run(spark: SparkSession, source: Marketplace, output: str, options: JobOptions | None = None) -> dict[str, DataFrame]:
    """Run every stage and return the published tables by name."""
    options = options or JobOptions()
    core, dashboard, models, reports = (f"{output}/{part}" for part in ("core", "dashboard", "models", "reports"))

    # a broken contract stops the run before anything is derived
    findings = writers.write_table(quality.key_findings(source.tables), reports, "key_findings")
    if options.check_keys:
        broken = [r["table_name"] for r in findings.where(~F.col("is_key")).collect()]
        fatal = sorted(set(broken) & set(options.fatal_keys))
        if fatal:
            raise quality.ContractError(f"Keys do not hold: {fatal}")
    validation = writers.write_table(
        quality.validation_report(source.tables, options.expected_rows), reports, "data_validation"
    )

    # the contract keys hold from here on, so the joins don't check them again
    held = [r["table_name"] for r in findings.where("is_key").collect()]
    with verified_keys(held):
        m = publish_core(source, core)
    audit = quality.grain_audit(
        m.tables, m.order_level, m.customer_features, m.zip_summary, m.items_per_order, m.payments_per_order
    )
    audit = writers.write_table(audit, reports, "grain_audit")
    quality.require_ok(audit)

    published = dict(m.published)
    for name, build in dashboard_tables(m, options.minimum_orders).items():
        if name != "overview":
            published[name] = writers.write_table(build(), dashboard, name)

    risk = delivery.train(m.order_level, options.delivery)
    risk.model.write().overwrite().save(f"{models}/delivery_risk")
    segments = segmentation.train(m.customer_features, restarts=options.segment_restarts)
    segments.model.write().overwrite().save(f"{models}/segmentation")
    repeat = retention.train(m.order_level, options.cutoff, options.horizon_end)
    if repeat.model is not None:
        repeat.model.write().overwrite().save(f"{models}/retention")
    series = forecast.split_months(
        forecast.complete_months(
            marts.monthly_sales(m.order_level).withColumn(SERIES, F.lit("all")), SERIES, options.minimum_orders
        ),
        SERIES,
    )
    sales_models = forecast.compare_models(forecast.validation_predictions(series, SERIES), SERIES).drop(SERIES)
    for name, df in {
        "delivery_predictions": risk.predictions,
        "delivery_feature_importance": risk.importance,
        "delivery_confusion_matrix": risk.confusion.toDF("actual", "predicted_on_time", "predicted_late"),
        "delivery_roc_curve": risk.roc,
        "delivery_pr_curve": risk.pr,
        "customer_segments": segments.segments,
        "segment_summary": segments.profiles,
        "retention_predictions": repeat.predictions,
        "model_metrics": model_metrics(risk.metrics, sales_models, segments.metrics, repeat.metrics),
    }.items():
        published[name] = writers.write_table(df, dashboard, name)

    published["kpis"] = writers.write_table(kpis.kpi_row(m.order_level, m.customer_features), dashboard, "kpis")
    published["business_insights"] = writers.write_table(
        insights.business_insights(
            published["kpis"],
            m.order_level,
            m.customer_features,
            published["monthly_sales"].where("is_complete"),
            published["product_summary"],
            published["seller_summary"],
            published["state_sales"],
            published["payment_summary"],
            published["delay_review_summary"],
        ),
        dashboard,
        "business_insights",
    )
    for name in ("model_metrics", "business_insights", "kpis"):
        writers.write_csv(published[name], f"{output}/csv", name)

    facts = spark.createDataFrame(
        [tuple(json.dumps(part.metadata, default=str) for part in (risk, segments, repeat))],
        "delivery_risk string, segmentation string, retention string",
    )
    writers.write_report(
        writers.report_row(
            spark,
            {
                "kpis": published["kpis"],
                "validation": writers.nested_rows(validation, "tables"),
                "identities": quality.identity_report(m.tables),
                "insights": writers.nested_rows(published["business_insights"], "rows"),
                "forecast": forecast.forecast_facts(series, published["model_metrics"].where("module = 'Forecasting'")),
                "delivery_confusion": writers.nested_rows(published["delivery_confusion_matrix"], "rows"),
                "models": facts,
            },
        ),
        reports,
        "run_results",
    )
    if options.jdbc_url:
        writers.load_relational(m.tables, options.jdbc_url, options.jdbc_properties)
    return {**published, "key_findings": findings, "data_validation": validation, "grain_audit": audit}
