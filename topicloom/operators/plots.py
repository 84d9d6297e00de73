"""Plot tables: coordinates of the rows of topics in two or three dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from topicloom.constants import OUTLIER_ID
from topicloom.functions.text import preview
from topicloom.operators.joins import keep_refined
from topicloom.operators.layout import AXES, NotConverged, fuzzy_graph, neighbor_layout, spread
from topicloom.operators.neighbors import knn_graph
from topicloom.operators.projection import reduce_dimensions, reduction_params
from topicloom.scratch import materialize


def coordinates(
    rows: DataFrame, components: int, vec_col: str = "embedding", method: str = "neighbors"
) -> DataFrame:
    """(row_id, x, y[, z]) by the rules of ``reduction_params``.

    The layout of the neighbour graph, spread by the rule's spacing; principal components for
    too few rows, where the layout does not settle, and for ``method="pca"``. Axes that few rows
    do not have are zero. ``rows`` should be a written table.
    """
    if method not in ("neighbors", "pca"):
        raise ValueError(f"unknown method {method!r}")
    n = rows.count()
    rule = rows.sparkSession.range(1).select(*reduction_params(F.lit(n), F.lit(components))).first()
    if method == "neighbors" and rule["method"] == "neighbors":
        graph = materialize(
            fuzzy_graph(materialize(knn_graph(rows, rule["n_neighbors"], vec_col=vec_col), "plot-knn")), "plot-graph"
        )
        try:
            placed = neighbor_layout(graph, components)
        except NotConverged:
            placed = None
        if placed is not None:
            return spread(placed, graph, rule["min_dist"], AXES[:components])
    reduced = reduce_dimensions(rows, vec_col, components)
    return reduced.select("row_id", *[F.col("reduced")[i].alias(AXES[i]) for i in range(components)])


def plot_table(
    topics: DataFrame, text_col: str, components: int, vec_col: str = "embedding",
    method: str = "neighbors", refined: DataFrame | None = None,
) -> DataFrame:
    """(row_id, x, y[, z], topic_id, topic_name, text) without outliers.

    Of ``topics`` only the rows of the ``refined`` selection are placed, if there is one.
    Outliers take part in the placing and are dropped afterwards. Three-dimensional tables carry
    a text preview, two-dimensional ones the whole text.
    """
    rows = topics if refined is None else keep_refined(topics, refined)
    rows = materialize(rows, "plot-rows")
    placed = materialize(coordinates(rows, components, vec_col, method), "plot-coordinates")
    text = F.col(text_col) if components == 2 else preview(F.col(text_col))
    shown = rows.filter(F.col("topic_id") != OUTLIER_ID).select("row_id", "topic_id", "topic_name", text.alias("text"))
    return placed.join(shown, "row_id")
