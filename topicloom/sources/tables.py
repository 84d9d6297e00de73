"""CSV reviews, row identity and CSV export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from topicloom.functions.text import na_to_null
from topicloom.scratch import materialize

CSV_DIALECT = {"header": "true", "quote": '"', "escape": '"'}


class SourceError(Exception):
    """A table could not be read; the message names the path and the cause."""


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, normalize: bool = True,
    bad_cells: str | None = None, line_breaks: bool = True,
) -> DataFrame:
    """Reviews with quoted line breaks and doubled quotes; values stay strings without a schema.

    A date-like or numeric-looking column must not change its type before the text column is
    found, so no types are inferred. With a schema a value that does not fit becomes NULL;
    ``bad_cells`` names a column that lists the columns where this happened, after
    missing-value tokens became NULL. Files whose values have no line breaks are split between
    tasks with ``line_breaks=False``; otherwise a file is read by one task.
    """
    reader = spark.read.options(**CSV_DIALECT, multiLine=str(line_breaks).lower(), inferSchema="false")
    typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if bad_cells is not None and typed is None:
        raise ValueError("bad cells need a schema")
    if bad_cells is not None:
        reader = reader.schema(StructType([StructField(f.name, StringType()) for f in typed]))
    elif typed is not None:
        reader = reader.schema(typed)
    try:
        df = reader.csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise SourceError(f"{path} was not found") from e
        raise SourceError(f"the table at {path} is unreadable: {e}") from e
    df = normalize_missing(df) if normalize else df
    return df if bad_cells is None else cast_cells(df, typed, bad_cells)


def cast_cells(df: DataFrame, schema: StructType, bad_cells: str) -> DataFrame:
    """String columns cast to ``schema``, and the names of the columns whose value did not fit.

    A missing value is not a bad one. Spaces around numbers don't matter. ``bad_cells`` names the
    new column, an empty array for good rows.
    """
    cast = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema}
    bad = [
        F.when(F.col(f"`{name}`").isNotNull() & value.isNull(), F.lit(name)) for name, value in cast.items()
    ]
    return df.select(
        *[value.alias(name) for name, value in cast.items()],
        F.array_compact(F.array(*bad)).cast("array<string>").alias(bad_cells),
    )


def normalize_missing(df: DataFrame) -> DataFrame:
    """Missing-value tokens of every string column become NULL."""
    return df.select(*[
        na_to_null(F.col(f"`{f.name}`")).alias(f.name)
        if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def write_csv(df: DataFrame, path: str) -> None:
    """Header, minimal quoting, surrounding spaces kept; one file per partition."""
    df.write.options(
        **CSV_DIALECT, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(path)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number rows 0..n-1 in file order and freeze the numbering in a written table.

    Works on a table read from files, before any filter. Rows of one file keep their order;
    files follow each other by path. Only per-file counts are ordered globally. For sources
    that are split within files use :func:`with_parquet_row_id`.
    """
    frozen = materialize(
        df.select("*", F.col("_metadata.file_path").alias("_file"))
        .withColumn("_seq", F.monotonically_increasing_id()),
        "row-id",
    )
    files = frozen.groupBy("_file").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    return _number(frozen, files, F.col("_seq") - F.col("_first"), name).drop("_seq", "_first")


def with_parquet_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number rows 0..n-1 by file path and position in the file, from Parquet metadata."""
    located = df.select(
        "*", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_seq"),
    )
    files = located.groupBy("_file").agg((F.max("_seq") + 1).alias("_n"))
    return _number(located, files, F.col("_seq"), name).drop("_seq")


def _number(rows: DataFrame, files: DataFrame, position, name: str) -> DataFrame:
    # One row per file; its size is known to the planner once written.
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        files.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"),
        "file-offsets",
    )
    return (
        rows.join(offsets, "_file")
        .withColumn(name, F.col("_offset") + position)
        .drop("_file", "_offset")
    )


def export_frame(topics: DataFrame, text_col: str) -> DataFrame:
    """The three result columns, outliers included."""
    return topics.select(F.col(text_col).alias("review_text"), "topic_id", "topic_name")


def export_csv(topics: DataFrame, text_col: str, path: str) -> None:
    write_csv(export_frame(topics, text_col), path)


def view(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The cleaned, unfiltered table; ``rows`` bounds what is shown."""
    return df if rows is None else df.limit(rows)
