"""The topic model: vectors to clusters to weighted, merged, numbered and named topics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, functions as F

from topicloom.constants import ENGLISH_STOP_WORDS, KEYWORDS_IN_DETAIL, MIN_ROWS_TO_MODEL
from topicloom.operators import clusters, naming, weights
from topicloom.operators.density import density_clusters
from topicloom.operators.embed import hashed_tfidf
from topicloom.operators.facets import adaptive_params
from topicloom.operators.joins import map_topic_names
from topicloom.operators.projection import reduce_dimensions
from topicloom.scratch import materialize


class TooFewRows(ValueError):
    """The selection is too small for a topic model."""


@dataclass(frozen=True)
class TopicParams:
    """Everything a fit depends on besides its rows.

    ``n_topics`` and ``min_topic_size`` follow from the number of rows when left out.
    """

    method: str = "density"
    n_topics: int | None = None
    min_topic_size: int | None = None
    reduced_dims: int = 5
    first_clusters: int = 20
    language: str = "english"
    stop_words: Sequence[str] = field(default_factory=lambda: tuple(ENGLISH_STOP_WORDS))
    keywords: int = KEYWORDS_IN_DETAIL
    count_outlier: bool = True
    min_rows: int = MIN_ROWS_TO_MODEL
    seed: int = 42

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class TopicModel:
    """Written tables of one fit. ``topics`` holds the rows with topic_id and topic_name."""

    topics: DataFrame
    weights: DataFrame
    keywords: DataFrame
    names: DataFrame
    params: TopicParams


def fit(
    rows: DataFrame, text_col: str, embeddings: DataFrame | None = None,
    params: TopicParams = TopicParams(),
) -> TopicModel:
    """Model ``rows`` (row_id, text, ...) with the vectors of ``embeddings`` (row_id, embedding).

    Rows without a vector take no part. Without ``embeddings`` the texts are encoded by
    hashed TF-IDF. Reports on a refined selection semi-join the result and never refit.
    """
    if embeddings is None:
        vectors = hashed_tfidf(rows, text_col).withColumnRenamed("features", "embedding")
    else:
        vectors = rows.select("row_id").join(embeddings.select("row_id", "embedding"), "row_id")
    vectors = materialize(vectors, "model-vectors")
    n = vectors.count()
    if n < params.min_rows:
        raise TooFewRows(f"{n} rows with embeddings; at least {params.min_rows} are needed")
    n_topics, min_size = _sizes(rows, params)

    reduced = materialize(
        reduce_dimensions(vectors, "embedding", params.reduced_dims).select("row_id", "reduced"),
        "reduced",
    )
    if params.method == "density":
        found = density_clusters(reduced, "reduced", min_size)
    elif params.method == "kmeans":
        k = min(params.first_clusters, max(1, n // min_size))
        found = clusters.kmeans_topics(reduced, "reduced", k, min_size, params.seed)
    else:
        raise ValueError(f"unknown method {params.method!r}")
    assigned = materialize(found.select("row_id", "topic_id"), "assigned")

    terms = materialize(
        weights.class_terms(
            rows.join(assigned, "row_id"), text_col, params.language, params.stop_words, n
        ),
        "class-terms",
    )
    counts = weights.held_counts(terms)
    totals = materialize(weights.topic_terms(counts), "topic-terms")
    sizes = assigned.groupBy("topic_id").agg(F.count("*").alias("n"))
    merges = clusters.reduce_topics(
        weights.with_idf(counts, totals), sizes, n_topics, params.count_outlier
    )
    ranks = clusters.size_ranks(clusters.relabel(assigned, merges))
    final = materialize(
        merges.withColumnRenamed("new_id", "merged")
        .join(ranks.withColumnRenamed("topic_id", "merged"), "merged")
        .select("topic_id", "new_id"),
        "final-ids",
    )
    # Merged topics add up the term counts; the texts are not read again, nor do terms travel again.
    merged_totals = materialize(
        clusters.relabel(totals, final).groupBy("topic_id").agg(F.sum("topic_terms").alias("topic_terms")),
        "merged-topic-terms",
    )
    term_weights = materialize(
        weights.weighted(weights.merged_counts(terms, final), merged_totals), "term-weights"
    )
    keywords = materialize(weights.topic_keywords(term_weights, params.keywords), "keywords")
    topics = rows.join(clusters.relabel(assigned, final), "row_id")
    ids = final.select(F.col("new_id").alias("topic_id"))
    names = materialize(naming.name_topics(ids, keywords), "names")
    return TopicModel(
        materialize(map_topic_names(topics, names), "topics"), term_weights, keywords, names, params
    )


def _sizes(rows: DataFrame, params: TopicParams) -> tuple[int, int]:
    if params.n_topics is not None and params.min_topic_size is not None:
        return params.n_topics, params.min_topic_size
    row = adaptive_params(rows.agg(F.count("*").alias("n"))).first()
    n_topics = row["n_topics"] if params.n_topics is None else params.n_topics
    min_size = row["min_topic_size"] if params.min_topic_size is None else params.min_topic_size
    return n_topics, min_size
