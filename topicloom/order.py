"""Global ranks and running sums without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from topicloom.scratch import materialize


def running(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before this one in ``order``.

    ``rows`` should be a narrow written table, because it is sampled for the range partitions;
    ``order`` must be unique. Only one sum per partition meets in one task.
    """
    placed = materialize(
        rows.withColumn("_value", value).repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id()),
        "placed",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        placed.groupBy("_part").agg(F.sum("_value").alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")),
        "starts",
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(starts, "_part").withColumn(name, F.col("_inside") + F.col("_start"))
        .drop("_value", "_part", "_inside", "_start")
    )


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a gapless rank from 0 in ``order``, as ``running`` does."""
    return running(rows, order, F.lit(1).cast("long"), name)
