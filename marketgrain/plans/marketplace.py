"""The tables of one marketplace, derived on demand.

Every attribute is a lazy DataFrame; Spark plans across all of them, so nothing is materialised that
the asked result does not read. ``with_published`` swaps a derived table for its stored copy.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from marketgrain.plans import grains, marts
from marketgrain.plans.clean import clean_tables, with_categories
from marketgrain.plans.order_level import build_order_level
from marketgrain.sources.sample_views import sample_tables
from marketgrain.sources.schemas import RELATIONAL_NAMES

PARTS = ("customers", "items", "payments", "reviews", "context", "geo")


class Marketplace:
    def __init__(self, tables: Mapping[str, DataFrame], published: Mapping[str, DataFrame] | None = None):
        """``tables`` are the nine source tables, cleaned (see ``clean.clean_tables``)."""
        self.tables = tables
        self.published = dict(published or {})

    @classmethod
    def from_raw(cls, raw: Mapping[str, DataFrame]) -> Marketplace:
        """Over tables as read from text files: strips text, parses dates, names categories."""
        return cls(clean_tables(raw))

    @classmethod
    def from_samples(cls, spark: SparkSession, folder: str) -> Marketplace:
        """Over the sample parquet files, whose text and types are clean."""
        return cls(with_categories(sample_tables(spark, folder)))

    def with_published(self, **published: DataFrame) -> Marketplace:
        return Marketplace(self.tables, {**self.published, **published})

    def register_views(self) -> list[str]:
        """The source tables as temporary views under their relational names, for ``spark.sql``."""
        for table, view in RELATIONAL_NAMES.items():
            self.tables[table].createOrReplaceTempView(view)
        return list(RELATIONAL_NAMES.values())

    @cached_property
    def zip_summary(self) -> DataFrame:
        return self.published.get("geolocation_zip_summary") or grains.zip_summary(self.tables["geolocation"])

    @cached_property
    def customers_geo(self) -> DataFrame:
        return grains.customers_geo(self.tables["customers"], self.zip_summary)

    @cached_property
    def sellers_geo(self) -> DataFrame:
        return grains.sellers_geo(self.tables["sellers"], self.zip_summary)

    @cached_property
    def items(self) -> DataFrame:
        """Order items with category and weight."""
        stored = self.published.get("seller_order_items")
        return stored or grains.categorised_items(self.tables["order_items"], self.tables["products"])

    @cached_property
    def enriched_items(self) -> DataFrame:
        """Items with the seller's place too."""
        return self.published.get("seller_order_items") or grains.enriched_items(self.items, self.sellers_geo)

    @cached_property
    def items_per_order(self) -> DataFrame:
        stored = self.published.get("order_items_order_level")
        return stored or grains.items_per_order(self.tables["order_items"])

    @cached_property
    def payments_per_order(self) -> DataFrame:
        stored = self.published.get("payments_order_level")
        return stored or grains.payments_per_order(self.tables["payments"])

    @cached_property
    def reviews_per_order(self) -> DataFrame:
        stored = self.published.get("reviews_order_level")
        return stored or grains.reviews_per_order(self.tables["reviews"])

    def orders(self, *parts: str) -> DataFrame:
        """The order table with the named parts only: ``customers items sums payments reviews context geo``.

        ``sums`` is ``items`` without its distinct counts, ``geo`` adds coordinates to customers and context.
        """
        if "order_level" in self.published:
            return self.published["order_level"]
        geo = "geo" in parts
        items, context = None, None
        if {"items", "context"} <= set(parts) and "order_items_order_level" not in self.published:
            items = grains.order_facts(self.tables["order_items"], self.tables["products"], self._sellers(geo))
        else:
            if "items" in parts:
                items = self.items_per_order
            elif "sums" in parts:
                items = grains.order_sums(self.tables["order_items"])
            context = self._context(geo) if "context" in parts else None
        customers = self.customers_geo if geo else self.tables["customers"]
        return build_order_level(
            self.tables["orders"],
            customers=customers if "customers" in parts or geo else None,
            items=items,
            payments=self.payments_per_order if "payments" in parts else None,
            reviews=self.reviews_per_order if "reviews" in parts else None,
            context=context,
        )

    def _sellers(self, geo: bool) -> DataFrame:
        return self.sellers_geo if geo else self.tables["sellers"]

    def _context(self, geo: bool) -> DataFrame:
        folds = grains.categorised_folds(self.tables["order_items"], self.tables["products"])
        return grains.order_context(folds, self._sellers(geo))

    @cached_property
    def order_context(self) -> DataFrame:
        return self._context(geo=True)

    @cached_property
    def order_level(self) -> DataFrame:
        """All parts."""
        return self.orders(*PARTS)

    @cached_property
    def customer_features(self) -> DataFrame:
        stored = self.published.get("customer_level")
        return stored or marts.customer_features(self.orders("customers", "sums", "reviews"), self.items)
