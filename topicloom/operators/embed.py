"""Text embeddings: hashed TF-IDF inside the JVM, or a user's encoder in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from topicloom.constants import ENCODE_BATCH
from topicloom.functions import text as T
from topicloom.scratch import materialize


def hashed_tfidf(
    df: DataFrame, text_col: str, dim: int = 512, language: str = "any",
) -> DataFrame:
    """(row_id, features): sparse unit-length TF-IDF vectors over hashed words.

    The hashed counts are written first, so the texts are read and split only once although
    the document frequencies need a pass of their own.
    """
    words = df.select(
        "row_id", T.tokens(T.prepare(F.col(text_col), language), language).alias("_words")
    )
    hashed = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(words)
    counted = materialize(hashed.select("row_id", "_tf"), "hashed-counts")
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted).transform(counted)
    scaled = Normalizer(inputCol="_tfidf", outputCol="features").transform(weighted)
    return scaled.select("row_id", "features")


def embed_documents(df: DataFrame, text_col: str, dim: int = 512, language: str = "any") -> DataFrame:
    """(row_id, embedding) by hashed TF-IDF."""
    return hashed_tfidf(df, text_col, dim, language).select(
        "row_id", vector_to_array("features", "float32").alias("embedding")
    )


def encode_with(
    df: DataFrame, text_col: str, make_encoder: Callable[[], Callable],
    batch_size: int = ENCODE_BATCH,
) -> DataFrame:
    """(row_id, embedding) by a user's model.

    ``make_encoder`` runs once per Python worker and returns a function from an array of texts
    to a matrix with one row per text.
    """
    encode = predict_batch_udf(
        make_encoder, return_type=ArrayType(FloatType()), batch_size=batch_size
    )
    return df.select("row_id", encode(F.col(text_col)).alias("embedding"))
