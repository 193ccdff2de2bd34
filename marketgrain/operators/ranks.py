"""Exact positions over whole tables without a single-task sort.

A window without PARTITION BY moves every row to one task. Here the distinct keys are spread by
``repartitionByRange`` (so neither a hot group nor a hot value can fill one task: copies are counted
first), the partition number is pinned by a checkpoint, and each row's global position is the sum of
the ranges before its own plus its position inside the range.

Where the order is one numeric value, no partition number is needed: *cells*, ranges of the value that are known
beforehand, take the place of the ranges. They need no checkpoint and no job while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.functions.scalars import ratio
from marketgrain.session import pin

_RANGE = "__range"


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    weights: Sequence[str],
    groups: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """``df`` plus ``<weight>_before`` and ``<weight>_total`` for every weight.

    ``df`` must hold one row per (groups, order); ``<w>_before`` sums the weight of all earlier rows
    of the group, ``<w>_total`` that of the whole group.
    """
    groups = list(groups)
    direction = F.desc if descending else F.asc
    # without a fixed number, adaptive execution merges small neighbouring ranges
    ranges = df.repartitionByRange(*[F.asc(g) for g in groups], *[direction(o) for o in order])
    ranged = pin(ranges.withColumn(_RANGE, F.spark_partition_id()))
    # one row per (group, range): at most groups + partitions rows, whatever the data size
    pieces = ranged.groupBy(*groups, _RANGE).agg(*[F.sum(w).alias(w) for w in weights])
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *groups,
        _RANGE,
        *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"__{w}_offset") for w in weights],
        *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights],
    )
    inside = (
        Window.partitionBy(*groups, _RANGE)
        .orderBy(*[direction(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    keys = [*groups, _RANGE]
    return (
        ranged.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"__{w}_inside") for w in weights])
        .join(offsets, keys)
        .select(
            *df.columns,
            *[(F.col(f"__{w}_offset") + F.col(f"__{w}_inside")).alias(f"{w}_before") for w in weights],
            *[F.col(f"{w}_total") for w in weights],
        )
    )


def _counted(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("copies"))


#: Cells between two neighbouring powers of two.
_CELLS = 4096
_CELL = "__cell"


def value_cell(value: Column) -> Column:
    """A whole number that never falls as ``value`` rises, whatever the range of the values.

    Each power of two is cut into equal cells, so a cell is a few thousandths of its values wide and an outlier
    doesn't widen the cells of the others. Not-a-number comes last.
    """
    number = value.cast("double")
    size = F.abs(number)
    exponent = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * _CELLS)
    cell = F.when(size == float("inf"), 5000 * _CELLS).otherwise((exponent + 1100) * _CELLS + part)
    signed = F.when(number < 0, -cell).otherwise(cell)
    return F.when(F.isnan(number), 6000 * _CELLS).when(number == 0, 0).otherwise(signed).cast("bigint")


def value_totals(
    df: DataFrame, value: str, weights: Sequence[str], groups: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """``running_totals`` in the order of one numeric ``value``, in one lazy plan.

    A group has at most as many cells as its values take thousandths of a power of two, so the sums over its
    cells are small; inside a cell the values are added in order.
    """
    groups = list(groups)
    direction = F.desc if descending else F.asc
    placed = df.withColumn(_CELL, value_cell(F.col(value)))
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy(direction(_CELL)).rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*groups, _CELL).agg(*[F.sum(w).alias(w) for w in weights])
    offsets = cells.select(
        *groups,
        _CELL,
        *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"__{w}_offset") for w in weights],
        *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights],
    )
    inside = Window.partitionBy(*groups, _CELL).orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(offsets, [*groups, _CELL])
    return joined.select(
        *df.columns,
        *[(F.col(f"__{w}_offset") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"{w}_before") for w in weights],
        *[F.col(f"{w}_total") for w in weights],
    )


def exact_quantiles(df: DataFrame, value: str, fractions: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Rows (groups, fraction, quantile) with linear interpolation between neighbours.

    Equal to ``percentile`` but without a per-group buffer of values.
    """
    return counted_quantiles(_counted(df, groups, value), value, fractions, groups)


def counted_quantiles(
    counted: DataFrame, value: str, fractions: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """``exact_quantiles`` of a table of distinct values with their ``copies``.

    Only the cells that hold an asked position are looked at value by value.
    """
    groups = list(groups)
    placed = counted.select(*groups, value, "copies", value_cell(F.col(value)).alias(_CELL))
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy(_CELL).rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*groups, _CELL).agg(F.sum("copies").alias("__rows"))
    cells = cells.select(
        *groups,
        _CELL,
        "__rows",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__rows").over(whole).alias("__total"),
    )
    asked = cells.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    position = F.col("fraction") * (F.col("__total") - 1)
    asked = asked.withColumns({"__low": F.floor(position), "__high": F.ceil(position), "__part": position - F.floor(position)})

    def covers(rank: str, start: Column, size: Column) -> Column:
        return (start <= F.col(rank)) & (F.col(rank) < start + size)

    held = covers("__low", F.col("__offset"), F.col("__rows")) | covers("__high", F.col("__offset"), F.col("__rows"))
    asked = asked.where(held).drop("__rows", "__total")
    inside = (
        Window.partitionBy(*groups, "fraction", _CELL).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    values = placed.join(asked, [*groups, _CELL]).withColumn(
        "__before", F.col("__offset") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    )

    def at(rank: str) -> Column:
        return F.max(F.when(covers(rank, F.col("__before"), F.col("copies")), F.col(value))).cast("double")

    return (
        values.groupBy(*groups, "fraction")
        .agg(at("__low").alias("__lower"), at("__high").alias("__upper"), F.max("__part").alias("__part"))
        .select(
            *groups,
            "fraction",
            (F.col("__lower") + (F.col("__upper") - F.col("__lower")) * F.col("__part")).alias("quantile"),
        )
    )


def average_percent_rank(df: DataFrame, value: str) -> DataFrame:
    """One row per distinct value with ``percent``: the mean rank of its copies over the row count."""
    counted = value_totals(_counted(df, [], value), value, ["copies"])
    mean_rank = F.col("copies_before") + (F.col("copies") + 1) / 2
    return counted.select(value, "copies", (mean_rank / F.col("copies_total")).alias("percent"))


def running_shares(df: DataFrame, amount: str) -> DataFrame:
    """``df`` with ``share`` and ``cumulative_share`` of ``amount`` from the largest down.

    Equal amounts share one running value, as a range frame has it; no window runs over all rows.
    """
    folded = df.where(F.col(amount).isNotNull()).groupBy(amount).agg(F.sum(amount).alias("__sum"))
    placed = value_totals(folded, amount, ["__sum"], descending=True).select(
        F.col(amount).alias("__amount"), (F.col("__sum_before") + F.col("__sum")).alias("__running"), "__sum_total"
    )
    joined = df.join(placed, F.col(amount) == F.col("__amount"), "left")
    return joined.select(
        *df.columns,
        ratio(F.col(amount), F.col("__sum_total")).alias("share"),
        ratio(F.col("__running"), F.col("__sum_total")).alias("cumulative_share"),
    )


def row_at(df: DataFrame, order: Sequence[str], fraction: float) -> DataFrame:
    """The row at 0-based position int(fraction * n) in a total order, with ``rows`` = n and ``position``."""
    keyed = df.select(*order).withColumn("rows", F.lit(1).cast("bigint"))
    placed = running_totals(keyed, order, ["rows"])
    wanted = F.floor(F.lit(float(fraction)) * F.col("rows_total"))
    return placed.where(F.col("rows_before") == wanted).select(
        *order, F.col("rows_total").alias("rows"), F.col("rows_before").alias("position")
    )
