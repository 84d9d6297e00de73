"""Embeddings, neighbour graphs, clusters, layouts and the topic model."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, embedding_rows, named, table
from topicloom.operators import clusters, embed, layout
from topicloom.operators.density import density_clusters
from topicloom.operators.descent import descent_neighbors
from topicloom.operators.facets import clean, refine_multiselect
from topicloom.operators.neighbors import knn_graph as build_knn
from topicloom.operators.plots import plot_table
from topicloom.operators.projection import reduce_dimensions
from topicloom.plans.topic_model import TopicParams, fit
from topicloom.scratch import materialize

KNN_SQL = """
unit_rows AS (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))
    AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
sized AS (SELECT least(15, greatest(2, count(*) // 3)) AS k FROM embeddings),
pairs AS (
  SELECT a.vec_id AS row_id, b.vec_id AS nbr_id, greatest(1 - list_inner_product(a.v, b.v), 0) AS dist
  FROM unit_rows a JOIN unit_rows b ON a.vec_id <> b.vec_id),
knn AS (
  SELECT row_id, nbr_id, rank, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(dist, 9), nbr_id) AS rank
    FROM pairs) WHERE rank <= (SELECT k FROM sized))
"""


@check("knn_graph", f"""
WITH {KNN_SQL} SELECT row_id, nbr_id, rank, round(dist, 6) AS dist FROM knn""")
def knn_graph(spark, sf_dir):
    return build_knn(embedding_rows(spark, sf_dir)).withColumn("dist", F.round("dist", 6))


@check("knn_descent")
def knn_descent(spark, sf_dir):
    return build_knn(embedding_rows(spark, sf_dir), search=descent_neighbors).withColumn("dist", F.round("dist", 6))


def _half_sum(rows: str) -> str:
    return f"list_sum(list_transform(d, lambda x: CASE WHEN x <= rho THEN 1.0 ELSE exp(-(x - rho) / {rows}) END))"


FUZZY_SQL = KNN_SQL + f""",
near AS (
  SELECT row_id, d, log2(len(d)) AS goal,
    coalesce(list_min(list_filter(d, lambda x: x > 0)), 0) AS rho
  FROM (SELECT row_id, list(dist ORDER BY dist) AS d FROM knn GROUP BY row_id)),
bisection AS (
  SELECT row_id, d, goal, rho, 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high,
    CAST(1 AS DOUBLE) AS mid FROM near
  UNION ALL
  SELECT row_id, d, goal, rho, step + 1, low, high,
    CASE WHEN high IS NULL THEN mid * 2 ELSE (low + high) / 2 END
  FROM (
    SELECT row_id, d, goal, rho, step, mid,
      CASE WHEN {_half_sum('mid')} > goal THEN low ELSE mid END AS low,
      CASE WHEN {_half_sum('mid')} > goal THEN mid ELSE high END AS high
    FROM bisection WHERE step < 32)),
bands AS (SELECT row_id, rho, greatest(mid, list_avg(d) * 1e-3, 1e-12) AS sigma
  FROM bisection WHERE step = 32),
directed AS (
  SELECT least(k.row_id, nbr_id) AS a, greatest(k.row_id, nbr_id) AS b,
    CASE WHEN dist <= rho THEN 1.0 ELSE exp(-(dist - rho) / sigma) END AS s
  FROM knn k JOIN bands b ON k.row_id = b.row_id),
graph AS (
  SELECT a, b, CASE WHEN count(*) = 2 THEN max(s) + min(s) - max(s) * min(s) ELSE max(s) END
    AS weight FROM directed GROUP BY a, b)
"""


@check("fuzzy_graph", f"""
WITH RECURSIVE {FUZZY_SQL} SELECT a, b, round(weight, 6) AS weight FROM graph""")
def fuzzy_graph(spark, sf_dir):
    knn = materialize(build_knn(embedding_rows(spark, sf_dir)), "knn")
    return layout.fuzzy_graph(knn).withColumn("weight", F.round("weight", 6))


@check("neighbor_layout")
def neighbor_layout(spark, sf_dir):
    knn = materialize(build_knn(embedding_rows(spark, sf_dir)), "knn")
    return layout.neighbor_layout(materialize(layout.fuzzy_graph(knn), "fuzzy"))


def documents(spark, sf_dir):
    return clean(table(spark, sf_dir, "documents"), "text").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("review")
    )


def text_vectors(spark, sf_dir):
    """Five centred components of the hashed TF-IDF vectors, written once."""
    vectors = materialize(embed.hashed_tfidf(documents(spark, sf_dir), "review"), "features")
    return materialize(
        reduce_dimensions(vectors, "features", 5).select("row_id", "reduced"), "reduced"
    )


@check("embed_documents")
def embed_documents(spark, sf_dir):
    return embed.embed_documents(documents(spark, sf_dir), "review")


@check("kmeans_topics")
def kmeans_topics(spark, sf_dir):
    return clusters.kmeans_topics(text_vectors(spark, sf_dir), "reduced", 10, min_size=10).select(
        "row_id", "topic_id"
    )


@check("density_clusters")
def density_topics(spark, sf_dir):
    return density_clusters(text_vectors(spark, sf_dir), "reduced", min_size=10).select(
        "row_id", "topic_id"
    )


def plotted(spark, sf_dir):
    return named(spark, sf_dir).filter("embedding IS NOT NULL")


@check("project_2d")
def project_2d(spark, sf_dir):
    return plot_table(plotted(spark, sf_dir), "review", 2)


@check("project_3d")
def project_3d(spark, sf_dir):
    return plot_table(plotted(spark, sf_dir), "review", 3)


@check("project_2d_pca")
def project_2d_pca(spark, sf_dir):
    return plot_table(plotted(spark, sf_dir), "review", 2, method="pca")


@check("project_2d_refined")
def project_2d_refined(spark, sf_dir):
    rows = plotted(spark, sf_dir)
    return plot_table(rows, "review", 2, refined=refine_multiselect(rows, "age", ["de", "es"]))


@check("project_3d_few_rows")
def project_3d_few_rows(spark, sf_dir):
    """The longest text of each language: fewer rows than a layout in three dimensions needs."""
    rows = plotted(spark, sf_dir)
    longest = rows.groupBy("age").agg(F.max_by("row_id", F.struct(F.length("review"), -F.col("row_id"))).alias("row_id"))
    few = longest.filter(F.col("age") != "en").select("row_id")
    return plot_table(rows, "review", 3, refined=few)


@check("topic_model")
def topic_model(spark, sf_dir):
    model = fit(documents(spark, sf_dir), "review")
    return model.topics.select("row_id", "topic_id", "topic_name")


@check("topic_model_kmeans")
def topic_model_kmeans(spark, sf_dir):
    model = fit(documents(spark, sf_dir), "review", params=TopicParams(method="kmeans"))
    return model.topics.select("row_id", "topic_id", "topic_name")
