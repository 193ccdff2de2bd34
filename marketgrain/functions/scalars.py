"""Column expressions: text cleaning, calendar arithmetic, distance, safe ratios.

All of them stay on the JVM, so they live inside generated code next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean earth radius in kilometres.
EARTH_RADIUS_KM = 6371.0088

MICROS_PER_DAY = 86_400_000_000

# Fixed value: every character Python's str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends (``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def title_case(text: Column) -> Column:
    """Capitalise every run of letters, so "agro-industry" becomes "Agro-Industry"."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    capital = F.transform(runs, lambda run: F.concat(F.upper(run.substr(1, 1)), F.substr(run, F.lit(2))))
    return F.array_join(capital, "")


def readable(name: Column) -> Column:
    """``credit_card`` to ``Credit Card``."""
    return title_case(F.replace(name, F.lit("_"), F.lit(" ")))


def month_start(moment: Column) -> Column:
    """First instant of the month, independent of the session zone."""
    return F.trunc(moment.cast("date"), "month").cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    """Elapsed microseconds of zoneless times (``timestampdiff`` would read them in the session zone)."""
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")


def fractional_days(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_DAY))


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed days rounded toward minus infinity (not a count of calendar days)."""
    micros = micros_between(start, end)
    return ((micros - F.pmod(micros, F.lit(MICROS_PER_DAY))) / F.lit(MICROS_PER_DAY)).cast("int")


def month_distance(earlier: Column, later: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; null when any coordinate is null."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    chord = (
        F.sin(half_lat) * F.sin(half_lat)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    )
    complete = lat1.isNotNull() & lng1.isNotNull() & lat2.isNotNull() & lng2.isNotNull()
    # least() skips nulls, hence the guard
    return F.when(complete, 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), chord))))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def mean_money(amount: Column) -> Column:
    """Mean of a decimal as a double: ``avg`` of a decimal would round to its own scale."""
    return ratio(F.sum(amount), F.count(amount))


def money(text: float | str) -> Column:
    return F.lit(text).cast("decimal(12,2)")


def risk_band(probability: Column) -> Column:
    """Right-closed bands with edges 0.25 and 0.50."""
    return F.when(probability <= 0.25, "Low").when(probability <= 0.50, "Medium").when(probability.isNotNull(), "High")
