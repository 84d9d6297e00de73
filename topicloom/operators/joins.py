"""Equality joins between rows, embeddings, topics and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from topicloom.scratch import materialize


def join_embeddings(rows: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows with their embedding; rows without one drop out."""
    return rows.join(embeddings.select("row_id", "embedding"), "row_id")


def orphans(rows: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Keys on one side only: (row_id, side) with side 'no_embedding' or 'no_row'."""
    left, right = rows.select("row_id"), embeddings.select("row_id")
    return left.join(right, "row_id", "left_anti").withColumn("side", F.lit("no_embedding")).union(
        right.join(left, "row_id", "left_anti").withColumn("side", F.lit("no_row"))
    )


def keep_refined(topics: DataFrame, refined: DataFrame) -> DataFrame:
    """Topic rows that survive the refinement; vectors travel with their row."""
    return topics.join(refined.select("row_id"), "row_id", "left_semi")


def lookup(rows: DataFrame, dimension: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a dimension that may face a hot key.

    The dimension is computed once and written, so the planner broadcasts it only below its
    size threshold and otherwise falls back to a skew-aware sort-merge join.
    """
    return rows.join(materialize(dimension, "dimension"), key, how)


def map_topic_names(topics: DataFrame, names: DataFrame) -> DataFrame:
    """Topic name per row, NULL where the topic has none."""
    return lookup(topics, names.select("topic_id", "topic_name"), "topic_id")


def topic_id_by_name(topics: DataFrame) -> DataFrame:
    """The topic of the first row that carries the name; names may repeat."""
    return (
        topics.filter("topic_name IS NOT NULL").groupBy("topic_name")
        .agg(F.min_by("topic_id", "row_id").alias("topic_id"))
    )
