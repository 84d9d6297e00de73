"""Numeric expressions with lenient parsing and plain formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def coerce_numeric(c: Column) -> Column:
    """DOUBLE, or NULL where the value is not a finite decimal number.

    The guard keeps out what a cast alone accepts: type suffixes, NaN and infinities.
    """
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def truncate(c: Column) -> Column:
    """Whole part, towards zero."""
    return c.cast("long")


def one_decimal(c: Column) -> Column:
    """Half-even rounding to one decimal, without thousands separators."""
    return F.replace(F.format_number(c, 1), F.lit(","), F.lit(""))
