"""Null rules shared by every operator.

A flag over an unknown input is 0, a ratio with a zero or unknown denominator is
NULL, and NaN never exists past a source: comparisons in Spark rank NaN above
every number, so it is turned into NULL where data enters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def holds(condition: Column) -> Column:
    """Boolean form of :func:`flag`."""
    return F.coalesce(condition, F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL instead of raising or producing infinity."""
    return F.try_divide(numerator, denominator)


def finite(value: Column) -> Column:
    """Map NaN and +-infinity to NULL."""
    value = value.cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def to_number(value: Column) -> Column:
    """Numeric parse that gives NULL for anything that is not a finite number."""
    return finite(value.try_cast("double"))


def lenient_number(value: Column) -> Column:
    """Numeric parse that ignores thousands separators and percent signs."""
    return to_number(F.regexp_replace(value.cast("string"), "[,%]", ""))


def lenient_int(value: Column) -> Column:
    """Integer parse that ignores thousands separators; decimals are refused."""
    text = F.trim(F.regexp_replace(value.cast("string"), ",", ""))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def blank_to_null(value: Column) -> Column:
    """NULL for empty or whitespace-only text, otherwise the trimmed text."""
    trimmed = F.trim(value.cast("string"))
    return F.when(trimmed != "", trimmed)


def to_storage(value: Column, scale: int = 6) -> Column:
    """Round half-up to the stored decimal scale and return to double."""
    return value.cast(f"decimal(38,{scale})").cast("double")
