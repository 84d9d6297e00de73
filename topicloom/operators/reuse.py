"""Fingerprints of filters and parameters, and reuse of results written under them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def fingerprint(filters: Column) -> Column:
    """Digest of a MAP<STRING, ARRAY<STRING>> column that ignores key and value order."""
    entries = F.array_sort(F.transform(
        F.map_entries(filters),
        lambda e: F.struct(e["key"].alias("key"), F.array_sort(e["value"]).alias("values")),
    ))
    return F.sha2(F.to_json(entries), 256)


def fingerprint_of(spark: SparkSession, filters: Mapping, params: Mapping) -> str:
    """Digest of one run: its filters and every fit parameter."""
    merged = {f"filter:{k}": [str(v) for v in vs] for k, vs in filters.items() if vs}
    merged |= {f"param:{k}": [str(v)] for k, v in params.items()}
    row = spark.createDataFrame([(merged,)], "m map<string, array<string>>")
    return row.select(fingerprint(F.col("m"))).first()[0]


def data_digest(spark: SparkSession, *paths: str) -> str:
    """Digest of the files below ``paths``: their names, lengths and times of modification.

    Only the listing is read. The digest does not depend on its order.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    one = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("s"), F.bit_xor(one).alias("x"))
    return row.select(F.sha2(F.concat_ws("|", "n", "s", "x"), 256)).first()[0]


def written(spark: SparkSession, path: str) -> bool:
    """Whether a job has marked the folder as complete."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def reuse(
    spark: SparkSession, store: str, key: str, compute: Callable[[], DataFrame]
) -> DataFrame:
    """The result written under ``key``, computed and written first if there is none.

    Only a folder that its job has marked as complete counts as written.
    """
    path = f"{store.rstrip('/')}/{key}"
    if written(spark, path):
        return spark.read.parquet(path)
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
