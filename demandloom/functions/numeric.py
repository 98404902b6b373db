"""Numeric parsing and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int) -> Column:
    """Round half-up as a double; adding zero turns -0.0 into 0.0."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def scrub_number(text: Column) -> Column:
    """Keep digits and dots only, then cast. The minus sign and decimal commas are lost on purpose."""
    return F.regexp_replace(text.cast("string"), r"[^\d.]", "").try_cast("double")


def decimal_comma(text: Column) -> Column:
    """Number text that may use a comma as decimal mark."""
    return F.replace(F.trim(text.cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def safe_float(text: Column, default: float | None = None) -> Column:
    parsed = text.cast("string").try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def half_even(value: Column) -> Column:
    """Round to a whole number, ties to the even neighbour."""
    return F.bround(value, 0) + F.lit(0.0)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """NULL instead of an error or infinity when the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
