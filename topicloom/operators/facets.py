"""Cleaning, facet filters, cascading refinement, gates and size-dependent parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from topicloom.constants import (
    DEFAULT_MIN_TOPIC_SIZE, DEFAULT_TOPICS, MIN_ROWS_TO_MODEL, SMALL_DATASET_ROWS,
)
from topicloom.functions.numeric import coerce_numeric, truncate
from topicloom.functions.text import has_text

# Longer value lists are joined instead of inlined in the plan. Either way the values are
# cast to the column's type first; a value that can't be cast matches nothing.
MAX_INLINE_VALUES = 1_000


def clean(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text is neither missing nor blank."""
    return df.filter(has_text(F.col(text_col)))


def facet_filter(df: DataFrame, filters: Mapping[str, Sequence]) -> DataFrame:
    """AND over columns of "value is one of"; empty lists and absent columns do not restrict."""
    for col, values in filters.items():
        if not values or col not in df.columns:
            continue
        values, kind = list(values), df.schema[col].dataType
        if len(values) <= MAX_INLINE_VALUES:
            df = df.filter(F.col(col).isin([F.lit(v).try_cast(kind) for v in values]))
        else:
            wanted = [
                df.sparkSession.createDataFrame([(v,) for v in values if type(v) is t], ["v"])
                .select(F.col("v").try_cast(kind).alias(col))
                for t in {type(v) for v in values if v is not None}
            ]
            if wanted:
                df = df.join(reduce(DataFrame.union, wanted).distinct(), col, "left_semi")
            else:
                df = df.filter("false")
    return df


def facet_all(df: DataFrame, col: str) -> DataFrame:
    """The "All" choice: every observed value, so rows without a value drop out.

    A column with no value at all does not restrict.
    """
    observed = df.agg(F.bool_or(has_text(F.col(col))).alias("any")).scalar()
    return df.filter(has_text(F.col(col)) | ~F.coalesce(observed, F.lit(False)))


def facet_options(df: DataFrame, col: str) -> DataFrame:
    """Distinct values to choose from, ascending; cast a numeric facet before."""
    return df.filter(has_text(F.col(col))).select(col).distinct().orderBy(col)


def refine_multiselect(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return facet_filter(df, {col: values})


def numeric_bounds(df: DataFrame, col: str) -> DataFrame:
    """One row: lowest and highest number with whole bounds truncated towards zero."""
    number = coerce_numeric(F.col(col))
    return df.agg(F.min(number).alias("min_value"), F.max(number).alias("max_value")).select(
        "min_value", "max_value",
        truncate(F.col("min_value")).alias("lower_bound"),
        truncate(F.col("max_value")).alias("upper_bound"),
    )


def refine_range(
    df: DataFrame, col: str, lower: float | None = None, upper: float | None = None,
    bounds: str = "int",
) -> DataFrame:
    """Inclusive range over the coerced column, which replaces the original.

    The default bounds are the observed ones, truncated with ``bounds="int"`` (a fractional
    maximum then falls out) or kept with ``bounds="exact"``. Without any number every row stays.
    """
    found = numeric_bounds(df, col)
    low_name, high_name = (
        ("lower_bound", "upper_bound") if bounds == "int" else ("min_value", "max_value")
    )
    has_number = found.select(F.col("min_value").isNotNull().alias("any")).scalar()
    low = F.lit(lower) if lower is not None else found.select(low_name).scalar()
    high = F.lit(upper) if upper is not None else found.select(high_name).scalar()
    numbers = df.withColumn(col, coerce_numeric(F.col(col)))
    return numbers.filter(F.col(col).between(low, high) | ~has_number)


def refine_single(df: DataFrame, col: str, value) -> DataFrame:
    """Equality; "All" keeps every row, those without a value included."""
    return df if value == "All" else df.filter(F.col(col) == F.lit(value))


def refine(
    df: DataFrame, facets: Mapping[str, str | None], ages: Sequence = (),
    satisfaction: tuple[float | None, float | None] = (None, None), gender: str = "All",
) -> DataFrame:
    """Age, then satisfaction, then gender; default bounds come from the step before."""
    if facets.get("age"):
        df = refine_multiselect(df, facets["age"], ages)
    if facets.get("satisfaction"):
        df = refine_range(df, facets["satisfaction"], *satisfaction)
    if facets.get("gender"):
        df = refine_single(df, facets["gender"], gender)
    return df


def funnel(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """One row of counts: all rows, then rows passing each further condition, in one pass."""
    counts = [F.count("*").alias("total")]
    passed = F.lit(True)
    for name, condition in stages.items():
        passed = passed & condition
        counts.append(F.count_if(passed).alias(name))
    return df.agg(*counts)


def require_selection(selected: Sequence | None, require_facet: bool = True) -> None:
    """Refuse to model when no facet value is selected."""
    if require_facet and not selected:
        raise ValueError("select at least one facet value before running topic analysis")


def size_gate(
    rows: DataFrame, embeddings: DataFrame, minimum: int = MIN_ROWS_TO_MODEL
) -> DataFrame:
    """One row: rows, rows with an embedding, and whether that is enough to model."""
    flagged = rows.select("row_id").join(
        embeddings.select("row_id", F.lit(1).alias("has_vector")), "row_id", "left"
    )
    return flagged.agg(
        F.count("*").alias("n_rows"), F.count("has_vector").alias("n_embeddings")
    ).withColumn(
        "status", F.when(F.col("n_embeddings") < minimum, "too_small").otherwise("ok")
    )


def topic_count(n: Column) -> Column:
    """Topics to keep for ``n`` rows."""
    return F.when(
        n < SMALL_DATASET_ROWS, F.least(F.lit(3), F.floor(n / 5))
    ).otherwise(DEFAULT_TOPICS).cast("int")


def min_topic_size(n: Column) -> Column:
    """Rows a topic needs, for ``n`` rows."""
    return F.when(
        n < SMALL_DATASET_ROWS, F.greatest(F.lit(2), F.floor(n / 10))
    ).otherwise(DEFAULT_MIN_TOPIC_SIZE).cast("int")


def adaptive_params(counts: DataFrame, n_col: str = "n") -> DataFrame:
    n = F.col(n_col)
    return counts.withColumns(
        {"n_topics": topic_count(n), "min_topic_size": min_topic_size(n)}
    )
