"""One value convention for comparing results across engines.

Counts are 64-bit, money and ratios are doubles (ratios rounded to six places by the same double
arithmetic on both sides), everything else keeps its type.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _portable_column(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DecimalType):
        return column.cast("double").alias(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return (F.floor(column * 1000000.0 + 0.5) / 1000000.0).alias(field.name)
    if isinstance(field.dataType, T.IntegralType):
        return column.cast("bigint").alias(field.name)
    return column


def portable(df: DataFrame) -> DataFrame:
    return df.select(*[_portable_column(f) for f in df.schema.fields])


# spec letters: s string, l count, m money, d ratio, t timestamp, b boolean
_CASTS = {
    "s": "CAST({0} AS VARCHAR)",
    "l": "CAST({0} AS BIGINT)",
    "m": "CAST({0} AS DOUBLE)",
    "d": "floor(CAST({0} AS DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE",
    "t": "CAST({0} AS TIMESTAMP)",
    "b": "CAST({0} AS BOOLEAN)",
}


def portable_sql(views: dict[str, str], spec: str, body: str) -> str:
    """``body`` with the views it names in front and every column of ``spec`` ("name:letter ...") cast."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\b[a-z]\w*\b", text)) & views.keys() - needed:
            needed.add(name)
            visit(views[name])

    visit(body)
    heads = [f"{name} AS ({views[name]})" for name in views if name in needed]
    heads.append(f"answer AS ({body})")
    columns = []
    for item in spec.split():
        name, letter = item.split(":")
        columns.append(_CASTS[letter].format(name) + f" AS {name}")
    return f"WITH RECURSIVE {', '.join(heads)} SELECT {', '.join(columns)} FROM answer"
