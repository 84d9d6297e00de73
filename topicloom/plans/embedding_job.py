"""The batch job that finds, cleans and encodes the texts and writes the embedding store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from topicloom.operators.columns import find_text_column
from topicloom.operators.embed import embed_documents, encode_with
from topicloom.operators.facets import clean
from topicloom.sources import embeddings


def build_store(
    table: DataFrame, path: str, text_col: str | None = None,
    make_encoder: Callable[[], Callable] | None = None, model_name: str = "hashed-tfidf",
) -> str:
    """Write the store for ``table``, which carries ``row_id``; returns the text column."""
    column = find_text_column(table, text_col)
    if column is None:
        raise ValueError("none of the columns holds text")
    texts = clean(table, column).select("row_id", F.col(column).cast("string").alias(column))
    if make_encoder is None:
        vectors = embed_documents(texts, column)
    else:
        vectors = encode_with(texts, column, make_encoder)
    embeddings.save(
        vectors, path, model_name=model_name, text_column=column,
        source_columns=len(table.columns) - 1,
    )
    return column
