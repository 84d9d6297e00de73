"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Keys above a 1/HOT_FRACTION share of the rows are joined apart, so there are at most
# HOT_FRACTION of them and the broadcast of their right-hand rows is bounded.
HOT_FRACTION = 500
MIN_HOT_ROWS = 100_000


def hot_keys(
    rows: DataFrame, on: list[str], min_hot_rows: int = MIN_HOT_ROWS, total: int | None = None
) -> DataFrame | None:
    """Keys with more than ``max(min_hot_rows, rows / HOT_FRACTION)`` rows, or None.

    ``rows`` should be a written table, because it is counted.
    """
    total = rows.count() if total is None else total
    threshold = max(min_hot_rows, total // HOT_FRACTION)
    if total <= threshold:
        return None
    counted = rows.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > threshold)
    found = counted.select(*on)
    keys = found.collect()
    return rows.sparkSession.createDataFrame(keys, found.schema) if keys else None


def join_apart(
    rows: DataFrame, lookup: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner"
) -> DataFrame:
    """Join with ``lookup``, unique on ``on``; rows of a hot key take a map-side join."""
    if hot is None:
        return rows.join(lookup, on, how)
    hot = F.broadcast(hot.toDF(*on))
    hot_lookup = F.broadcast(lookup.join(hot, on, "left_semi"))
    warm = rows.join(hot, on, "left_semi").join(hot_lookup, on, how)
    cold = rows.join(hot, on, "left_anti").join(lookup, on, how)
    return warm.unionByName(cold)


def hot_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner",
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Find the hot keys of a written table and join them apart. ``how`` is inner or left."""
    return join_apart(rows, lookup, on, hot_keys(rows, on, min_hot_rows), how)
