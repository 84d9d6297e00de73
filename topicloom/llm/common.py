"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from topicloom.scratch import materialize

#: A word of the mixing and SimHash contracts: no space and none of \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One given table, with the named columns only."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return found.select(*columns) if columns else found


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a record batch of whole texts that a Python worker holds at once.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have texts go to Python in small batches; a session's own setting stays."""
    if spark.conf.get(BATCH_CONF) == "10000":  # Spark's default
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Add a gapless global rank from 0 in ``order``, without putting all rows in one task.

    ``rows`` should be a narrow written table: it is sampled for the range partitions, then
    written in order with its place in its partition; only one count per partition meets in
    one task. Rows equal in ``order`` are ranked arbitrarily, so make it unique.
    """
    placed = materialize(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_rank_at", F.monotonically_increasing_id())
        .withColumn("_rank_part", F.shiftrightunsigned("_rank_at", 33)),
        "ranked",
    )
    counts = placed.groupBy("_rank_part").agg(F.count("*").alias("_rank_n"))
    before = W.orderBy("_rank_part").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(
        counts.select("_rank_part", F.coalesce(F.sum("_rank_n").over(before), F.lit(0)).alias("_rank_start")),
        "rank-starts",
    )
    within = F.col("_rank_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(starts, "_rank_part").withColumn(rank, within + F.col("_rank_start"))
        .drop("_rank_at", "_rank_part", "_rank_start")
    )


def slices(batch, text: int, most: int = 4 << 20):
    """Cut a record batch into runs of rows whose column ``text`` holds about ``most`` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(lengths.astype(np.int64) + 64)
    start = 0
    while start < batch.num_rows:
        base = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
