"""Keys: joins that refuse to multiply rows, and one row per key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COPIES = "__copies"
_POSITION = "__position"


_verified: ContextVar[frozenset[str]] = ContextVar("verified", default=frozenset())


@contextmanager
def verified_keys(names: Iterable[str]) -> Iterator[None]:
    """Plans made inside don't check the keys of these sides again: a run checks each table once, when it starts."""
    token = _verified.set(_verified.get() | frozenset(names))
    try:
        yield
    finally:
        _verified.reset(token)


def unique_rows(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` itself, but the job fails when a key occurs twice.

    The number of repeated keys is a scalar subquery over the key columns alone, so it runs inside the
    same job, copies of a hot key fold before the shuffle, and ``df`` reaches its join unchanged:
    adaptive execution can still broadcast it or split a skewed partner. Sides that ``verified_keys`` names
    are taken as they are.
    """
    if name in _verified.get():
        return df
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_COPIES))
    repeated = copies.where(F.col(_COPIES) > 1).agg(F.count(F.lit(1))).scalar()
    failure = F.raise_error(F.lit(f"{name} key {list(keys)} is not unique")).cast("boolean")
    return df.where(F.when(repeated == 0, F.lit(True)).otherwise(failure))


def checked_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    expect: str = "m:1",
    name: str = "right side",
) -> DataFrame:
    """An equi-join that keeps the grain of ``left`` or fails.

    ``expect`` is ``"m:1"`` (keys of ``right`` must be unique) or ``"1:1"`` (both sides). A unique
    right key is what guarantees that no row is multiplied, so nothing has to be counted twice.
    """
    if expect not in ("m:1", "1:1"):
        raise ValueError(f"expect must be 'm:1' or '1:1', not {expect!r}")
    keys = [on] if isinstance(on, str) else list(on)
    if expect == "1:1":
        left = unique_rows(left, keys, "left side")
    return left.join(unique_rows(right, keys, name), keys, how)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in a total order.

    Spark keeps one candidate per key and task before the shuffle (window group limit), so a key
    that holds a large share of the rows does not travel.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_POSITION, F.row_number().over(window)).where(F.col(_POSITION) == 1).drop(_POSITION)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int) -> DataFrame:
    """The first ``count`` rows of every key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_POSITION, F.row_number().over(window)).where(F.col(_POSITION) <= count).drop(_POSITION)


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose grouping keys are known (a null key forms no group in the marts)."""
    return df.dropna(subset=list(columns))
