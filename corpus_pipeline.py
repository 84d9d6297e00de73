"""The corpus pipeline: language, near-duplicates, source weights, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it again as the next stage's documents.

Cases, for all stages: texts are processed whole at any length; further columns pass through
the first three stages unchanged, whatever their names; an empty table gives no rows. What nulls,
empty texts, ties and repeated rows come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicloom.llm import bpe, language, mixing, simhash
from topicloom.scratch import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the models reject go.

    A null or empty text, or one without a letter, is rejected; a null id, language or source
    is not; repeated rows are judged alike; of tied languages the first by code point counts.
    """
    return language.recognised(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates.

    Null ids come last; documents of one id go by the hash of their text; of repeated rows
    (equal id and text) one stays. Null and empty texts are one group.
    """
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it.

    The null source is a source of its own, the last; null and empty texts have no words and
    follow their source's repetitions; repeated rows are each repeated alike.
    """
    return mixing.repeated(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every mixed document.

    A null text is an empty one, with no tokens; null ids and repeated rows are each returned.
    """
    return bpe.digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe", tokenize),
]

#: The stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
