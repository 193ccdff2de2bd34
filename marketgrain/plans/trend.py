"""Linear trend with yearly sine and cosine, fitted in closed form inside the plan.

The regressors are the row index x, sin(2 pi m / 12) and cos(2 pi m / 12) of a month number m. All sums of products
that least squares needs follow from exact sums per month number, so one small aggregate holds a fit, and the
three weights solve a 3 by 3 system in column expressions. Sums per month number are exact for decimal amounts and
are added in month order, so a fit doesn't depend on how rows are dealt to tasks.

A short history does not determine three weights. As usual for least squares the weights of least length are taken
then: for a matrix of rank two or one the pseudo-inverse is a polynomial of the matrix, as it is for full rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SINES = [math.sin(2 * math.pi * m / 12) for m in range(1, 13)]
_COSINES = [math.cos(2 * math.pi * m / 12) for m in range(1, 13)]
#: A determinant below this share of its diagonal product counts as zero.
_SINGULAR = 1e-10

# Each step is a projection over the ones before it: centred sums, cofactors, weights.
_STEPS: tuple[dict[str, str], ...] = (
    {
        "mx": "x / n",
        "ms": "s / n",
        "mc": "c / n",
        "my": "y / n",
        "xx": "x2 - x * x / n",
        "xs": "sx - x * s / n",
        "xc": "cx - x * c / n",
        "ss": "s2 - s * s / n",
        "sc": "s_c - s * c / n",
        "cc": "c2 - c * c / n",
        "xy": "x_y - x * y / n",
        "sy": "s_y - s * y / n",
        "cy": "c_y - c * y / n",
    },
    {
        "k11": "ss * cc - sc * sc",
        "k12": "xc * sc - xs * cc",
        "k13": "xs * sc - xc * ss",
        "k22": "xx * cc - xc * xc",
        "k23": "xs * xc - xx * sc",
        "k33": "xx * ss - xs * xs",
        "trace": "xx + ss + cc",
    },
    {"det": "xx * k11 + xs * k12 + xc * k13", "minors": "k11 + k22 + k33"},
    {
        "rank": f"CASE WHEN det > {_SINGULAR} * xx * ss * cc AND xx > 1e-9 AND ss > 1e-9 AND cc > 1e-9 THEN 3 "
        f"WHEN (k11 > {_SINGULAR} * ss * cc AND ss > 1e-9 AND cc > 1e-9) "
        f"OR (k22 > {_SINGULAR} * xx * cc AND xx > 1e-9 AND cc > 1e-9) "
        f"OR (k33 > {_SINGULAR} * xx * ss AND xx > 1e-9 AND ss > 1e-9) THEN 2 "
        "WHEN trace > 1e-9 THEN 1 ELSE 0 END",
    },
    {
        "wx": "CASE rank WHEN 3 THEN (k11 * xy + k12 * sy + k13 * cy) / det "
        "WHEN 2 THEN (trace * xy - (xx * xy + xs * sy + xc * cy)) / minors WHEN 1 THEN xy / trace ELSE 0D END",
        "ws": "CASE rank WHEN 3 THEN (k12 * xy + k22 * sy + k23 * cy) / det "
        "WHEN 2 THEN (trace * sy - (xs * xy + ss * sy + sc * cy)) / minors WHEN 1 THEN sy / trace ELSE 0D END",
        "wc": "CASE rank WHEN 3 THEN (k13 * xy + k23 * sy + k33 * cy) / det "
        "WHEN 2 THEN (trace * cy - (xc * xy + sc * sy + cc * cy)) / minors WHEN 1 THEN cy / trace ELSE 0D END",
    },
)

FIT = ("mx", "ms", "mc", "my", "wx", "ws", "wc")


def sine(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in _SINES]), month.cast("int"))


def cosine(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in _COSINES]), month.cast("int"))


def fits(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the columns of ``FIT``, from ``points`` with the keys, ``x``, ``month`` (1 to 12) and ``y``."""
    monthly = points.groupBy(*keys, "month").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("x").alias("x"),
        F.sum(F.col("x") * F.col("x")).alias("x2"),
        F.sum("y").alias("y"),
        F.sum(F.col("x") * F.col("y")).alias("x_y"),
    )
    term = F.struct(
        "month", sine(F.col("month")).alias("s"), cosine(F.col("month")).alias("c"), "n", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")
    )
    whole = {c: F.sum(c).cast("double").alias(c) for c in ("n", "x", "x2", "y", "x_y")}
    summed = monthly.groupBy(*keys).agg(F.array_sort(F.collect_list(term)).alias("terms"), *whole.values())

    def total(of) -> Column:
        return F.aggregate("terms", F.lit(0.0), lambda before, t: before + of(t))

    products = {
        "s": lambda t: t.s * t.n,
        "c": lambda t: t.c * t.n,
        "s2": lambda t: t.s * t.s * t.n,
        "c2": lambda t: t.c * t.c * t.n,
        "s_c": lambda t: t.s * t.c * t.n,
        "sx": lambda t: t.s * t.x,
        "cx": lambda t: t.c * t.x,
        "s_y": lambda t: t.s * t.y,
        "c_y": lambda t: t.c * t.y,
    }
    fitted = summed.withColumns({name: total(of) for name, of in products.items()})
    for step in _STEPS:
        fitted = fitted.withColumns({name: F.expr(text) for name, text in step.items()})
    return fitted.select(*keys, *FIT)


def predicted(fit: Column, x: Column, month: Column) -> Column:
    """The fit (a struct of ``FIT``) at a row and month, not below zero."""
    value = fit.my + fit.wx * (x - fit.mx) + fit.ws * (sine(month) - fit.ms) + fit.wc * (cosine(month) - fit.mc)
    return F.greatest(value, F.lit(0.0))
