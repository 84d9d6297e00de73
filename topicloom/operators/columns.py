"""Finding the text column and the facet columns of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from topicloom.constants import FACET_CANDIDATES, TEXT_COLUMN_NAMES


def text_column_by_name(columns: Sequence[str]) -> str | None:
    """First column, in table order, with a known name."""
    return next((c for c in columns if c.lower() in TEXT_COLUMN_NAMES), None)


def mean_text_lengths(df: DataFrame) -> DataFrame:
    """(position, column, mean_chars) of the string columns that hold any value, in one pass.

    A missing value counts as the three characters 'nan'.
    """
    names = [(i, f.name) for i, f in enumerate(df.schema) if isinstance(f.dataType, StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "position int, column string, mean_chars double")
    stats = []
    for i, name in names:
        c = F.col(f"`{name}`")
        stats += [
            F.avg(F.length(F.coalesce(c, F.lit("nan")))).alias(f"mean_{i}"),
            F.count(c).alias(f"n_{i}"),
        ]
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("column"),
            F.col(f"mean_{i}").alias("mean_chars"), F.col(f"n_{i}").alias("n"),
        )
        for i, name in names
    ]))
    return (
        df.agg(*stats).select(rows.alias("s"))
        .filter("s.n > 0").select("s.position", "s.column", "s.mean_chars")
    )


def longest_text_column(df: DataFrame) -> DataFrame:
    """One row: the string column with the greatest mean length, the first one on a tie."""
    return mean_text_lengths(df).orderBy(F.desc("mean_chars"), "position").limit(1)


def find_text_column(df: DataFrame, text_col: str | None = None) -> str | None:
    """The explicit choice, else the known name, else the longest string column, else None."""
    if text_col is not None:
        if text_col not in df.columns:
            raise ValueError(f"no column {text_col!r}")
        return text_col
    named = text_column_by_name(df.columns)
    if named is not None:
        return named
    best = longest_text_column(df).select("column").collect()
    return best[0][0] if best else None


def resolve_facets(
    columns: Sequence[str], candidates: Mapping[str, Sequence[str]] = FACET_CANDIDATES
) -> dict[str, str | None]:
    """Column per facet: the first candidate present, in candidate order."""
    present = set(columns)
    return {
        facet: next((c for c in names if c in present), None)
        for facet, names in candidates.items()
    }
