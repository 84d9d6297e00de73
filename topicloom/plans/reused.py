"""Topic models and their names that are fitted once per data, filters and parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from topicloom.operators import naming, reuse
from topicloom.plans.topic_model import TopicModel, TopicParams, fit

TABLES = ("topics", "weights", "keywords", "names")


def fit_key(
    rows: DataFrame, sources: list[str], text_col: str, filters: Mapping, params: TopicParams
) -> str:
    """Digest of everything a fit depends on: files, text column, filters, parameters."""
    spark = rows.sparkSession
    merged = params.as_dict() | {"text column": text_col, "files": reuse.data_digest(spark, *sources)}
    return reuse.fingerprint_of(spark, filters, merged)


def fit_once(
    rows: DataFrame, text_col: str, store: str, sources: list[str], filters: Mapping | None = None,
    params: TopicParams = TopicParams(), embeddings: DataFrame | None = None,
) -> tuple[TopicModel, str]:
    """The model of ``rows`` and the folder of its tables, fitted only where ``store`` lacks it.

    ``rows`` are the rows of ``sources`` after ``filters``; the files of ``embeddings`` belong to
    ``sources`` too. A changed file, filter or parameter has another folder, and whatever was
    derived from the old fit stays in the old one.
    """
    spark = rows.sparkSession
    folder = f"{store.rstrip('/')}/{fit_key(rows, sources, text_col, filters or {}, params)}"
    if not all(reuse.written(spark, f"{folder}/{t}") for t in TABLES):
        model = fit(rows, text_col, embeddings, params)
        for t in TABLES:
            getattr(model, t).write.mode("overwrite").parquet(f"{folder}/{t}")
    return TopicModel(*(spark.read.parquet(f"{folder}/{t}") for t in TABLES), params), folder


def names_once(
    model: TopicModel, folder: str, text_col: str, model_name: str,
    make_client: Callable[[], Callable[[list[str]], list[str | None]]], cache: DataFrame | None = None,
) -> DataFrame:
    """Names by a text model, kept below the folder of their fit, so that they fall with it."""
    spark = model.topics.sparkSession

    def compute() -> DataFrame:
        known = model.names.limit(0) if cache is None else cache
        prompts = naming.topic_prompts(model.topics, model.keywords, model.names, text_col)
        return naming.names_by_model(model.names, model.keywords, prompts, known, make_client)

    key = reuse.fingerprint_of(spark, {}, {"model": model_name, "prompt": naming.NAME_TEMPLATE})
    return reuse.reuse(spark, folder, f"names-{key}", compute)
