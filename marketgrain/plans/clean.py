"""Cleaning: text, dates, products."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketgrain.functions.scalars import readable, strip
from marketgrain.operators.keys import checked_join
from marketgrain.sources.lazy import LazyTables
from marketgrain.sources.schemas import DATE_COLUMNS

MEASURED = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")


def clean_text(df: DataFrame) -> DataFrame:
    """White space stripped in every string column."""
    return df.select(
        *[
            strip(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def parse_dates(table: str, df: DataFrame) -> DataFrame:
    """The table's text date columns as timestamps; text that is no date becomes null."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(
        {c: F.expr(f"try_cast(`{c}` AS TIMESTAMP_NTZ)") for c in DATE_COLUMNS.get(table, ()) if c in text}
    )


def clean_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Readable category (translated, else source name, else Unknown); non-positive measures become null."""
    named = checked_join(clean_text(products), translation, "product_category_name", name="category translation")
    category = F.coalesce("product_category_name_english", "product_category_name", F.lit("Unknown"))
    return named.withColumns(
        {
            "product_category": readable(category),
            **{c: F.when(F.col(c) > 0, F.col(c)) for c in MEASURED if c in products.columns},
        }
    )


def clean_tables(raw: Mapping[str, DataFrame]) -> LazyTables:
    """Every table cleaned on demand; products carry their readable category."""
    cleaned = LazyTables({n: (lambda n=n: parse_dates(n, clean_text(raw[n]))) for n in raw})
    return with_categories(cleaned)


def with_categories(tables: LazyTables) -> LazyTables:
    """Tables that are clean already, with only the product category still to be named."""
    return tables.mapped({"products": lambda t: clean_products(t["products"], t["category_translation"])})
