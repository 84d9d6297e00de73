"""Arithmetic on ARRAY columns with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    length = norm(v)
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
