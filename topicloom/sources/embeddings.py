"""Embedding store: a Parquet table of (row_id, embedding) beside one row of metadata."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def metadata(
    embeddings: DataFrame, model_name: str, text_column: str, source_columns: int,
    vec_col: str = "embedding",
) -> DataFrame:
    """One row that describes the store; fails when vectors differ in width."""
    return embeddings.agg(
        F.count("*").alias("total_samples"),
        F.min(F.size(vec_col)).alias("_narrow"),
        F.max(F.size(vec_col)).alias("embedding_dim"),
    ).select(
        F.lit(model_name).alias("model_name"),
        F.when(F.col("_narrow") == F.col("embedding_dim"), F.col("embedding_dim"))
        .when(F.col("total_samples") > 0, F.raise_error(F.lit("embeddings differ in width")).cast("int"))
        .alias("embedding_dim"),
        "total_samples",
        F.lit(text_column).alias("text_column"),
        F.struct(
            F.col("total_samples").alias("rows"), F.lit(source_columns).alias("cols")
        ).alias("dataset_shape"),
    )


def save(embeddings: DataFrame, path: str, **described) -> None:
    """Write vectors keyed by row_id, then their metadata read back from the written table."""
    spark = embeddings.sparkSession
    embeddings.select("row_id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    written = spark.read.parquet(f"{path}/vectors")
    metadata(written, **described).write.mode("overwrite").parquet(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Vectors and metadata, or None with a warning when there is no store."""
    try:
        return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/metadata")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no embeddings at {path}; run the embedding job first", stacklevel=2)
        return None
