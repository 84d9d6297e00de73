"""Distributions, shares, samples and statistics of assigned topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from topicloom.constants import KEYWORDS_IN_DETAIL, OUTLIER_ID, SAMPLES_IN_DETAIL
from topicloom.functions.numeric import one_decimal


def drop_outliers(topics: DataFrame) -> DataFrame:
    return topics.filter(F.col("topic_id") != OUTLIER_ID)


def topic_distribution(topics: DataFrame, by: str = "topic_name") -> DataFrame:
    """Rows per topic without outliers, largest first; equal names merge."""
    return (
        drop_outliers(topics).filter(F.col(by).isNotNull())
        .groupBy(by).agg(F.count("*").alias("n_rows"))
        .orderBy(F.desc("n_rows"), by)
    )


def topic_share(topics: DataFrame) -> DataFrame:
    """Fraction of the named, non-outlier rows per topic name."""
    counts = topic_distribution(topics)
    total = counts.agg(F.sum("n_rows").alias("total")).scalar()
    return counts.withColumn("share", F.col("n_rows") / total)


def topic_ids(topics: DataFrame, outliers: bool = False) -> DataFrame:
    """Distinct topic ids, ascending."""
    kept = topics if outliers else drop_outliers(topics)
    return kept.select("topic_id").distinct().orderBy("topic_id")


def summary_stats(topics: DataFrame) -> DataFrame:
    """One row of totals; zeros when every row is an outlier."""
    pairs = topics.groupBy("topic_id", "topic_name").agg(F.count("*").alias("n"))
    valid = F.col("topic_id") != OUTLIER_ID
    largest = (
        pairs.filter(valid & F.col("topic_name").isNotNull())
        .groupBy("topic_name").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).scalar()
    )
    totals = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count_distinct(F.when(valid, F.col("topic_id"))).alias("topics_found"),
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("valid_rows"),
    )
    mean = F.coalesce(F.try_divide(F.col("valid_rows"), F.col("topics_found")), F.lit(0.0))
    return totals.select(
        "total_rows", "topics_found",
        mean.alias("mean_rows_per_topic"),
        F.when(F.col("topics_found") > 0, one_decimal(mean)).otherwise("0")
        .alias("mean_rows_text"),
        F.coalesce(largest, F.lit(0)).alias("largest_topic_rows"),
    )


def legend_order(topics: DataFrame) -> DataFrame:
    """Names of the plotted topics with their first row, in order of appearance."""
    return (
        drop_outliers(topics).groupBy("topic_name")
        .agg(F.min("row_id").alias("first_row")).orderBy("first_row")
    )


def topic_samples(
    topics: DataFrame, text_col: str, n: int = SAMPLES_IN_DETAIL, by: str = "topic_name"
) -> DataFrame:
    """The first ``n`` texts of each topic in row order, numbered from 1.

    Every task keeps only its own first ``n`` rows per topic before the shuffle, so a topic
    with most of the rows is no heavier than any other.
    """
    first = Window.partitionBy(by).orderBy("row_id")
    return (
        topics.filter(F.col(by).isNotNull()).select(by, "row_id", F.col(text_col).alias("sample"))
        .withColumn("sample_no", F.row_number().over(first))
        .filter(F.col("sample_no") <= n)
    )


def topic_details(
    topics: DataFrame, keywords: DataFrame, text_col: str,
    k: int = KEYWORDS_IN_DETAIL, n: int = SAMPLES_IN_DETAIL,
) -> DataFrame:
    """Keywords, row count and first texts for every topic that can be picked by name."""
    counts = (
        topics.filter("topic_name IS NOT NULL").groupBy("topic_name")
        .agg(
            F.count("*").alias("n_rows"),
            F.min_by("topic_id", "row_id").alias("topic_id"),
            F.bool_or(F.col("topic_id") != OUTLIER_ID).alias("listed"),
        )
        .filter("listed").drop("listed")
    )
    words = (
        keywords.filter(F.col("rank") <= k).groupBy("topic_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("ranked"))
        .select("topic_id", F.array_join(F.col("ranked.term"), ", ").alias("keywords"))
    )
    samples = topic_samples(topics, text_col, n).drop("row_id")
    return counts.join(words, "topic_id", "left").join(samples, "topic_name")
