"""Minimum spanning trees by Boruvka's rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from topicloom.scratch import materialize
from topicloom.skew import hot_join, hot_keys, join_apart


#: A graph of no more edges goes to the driver for its last rounds.
COLLECT_EDGES = 500_000


def spanning_tree(
    nodes: DataFrame, edges: DataFrame, collect_edges: int = COLLECT_EDGES
) -> tuple[DataFrame, DataFrame]:
    """The lightest edges (a, b, dist) that connect all of ``nodes``, and the graph's parts
    (node, part), as written tables.

    ``nodes`` is (node), ``edges`` is (a, b, dist) with a < b, each pair once. Edges compare by
    (dist, a, b), so the tree does not depend on partitions. Each round every component takes
    its lightest outgoing edge and the components joined by these become one; parallel edges
    between two components shrink to the lightest. Once the graph of components has at most
    ``collect_edges`` edges, the driver picks the rest of the tree from them. Parts of the graph
    without any edge between them are joined to the first part at an infinite distance.
    """
    spark = nodes.sparkSession
    pairs = edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "dist", "a", "b")
    rest = materialize(
        pairs.union(pairs.select(F.col("cb"), F.col("ca"), "dist", "a", "b")), "tree-edges"
    )
    parts = nodes.select("node", F.col("node").alias("part"))
    found: list[DataFrame] = []

    def moved(parts: DataFrame, pointers: DataFrame) -> DataFrame:
        ends = pointers.select(F.col("node").alias("part"), "up")
        return parts.join(ends, "part", "left").select("node", F.coalesce("up", "part").alias("part"))

    while (count := rest.count()) > 2 * collect_edges:
        best = materialize(
            rest.groupBy(F.col("ca").alias("node")).agg(F.min(F.struct("dist", "a", "b", "cb")).alias("e"))
            .select("node", F.col("e.cb").alias("up"), "e.dist", "e.a", "e.b"),
            "lightest",
        )
        found.append(best.select("a", "b", "dist").distinct())
        pointers = _roots(best.select("node", "up"))
        parts = materialize(moved(parts, pointers), "tree-parts")
        # Both directions of each edge are present, so both ends have the same hot components.
        hot = hot_keys(rest, ["ca"], total=count)
        a = pointers.select(F.col("node").alias("ca"), F.col("up").alias("pa"))
        b = pointers.select(F.col("node").alias("cb"), F.col("up").alias("pb"))
        far = None if hot is None else hot.toDF("cb")
        apart = join_apart(join_apart(rest, a, ["ca"], hot), b, ["cb"], far).filter("pa <> pb")
        rest = materialize(
            apart.groupBy(F.col("pa").alias("ca"), F.col("pb").alias("cb"))
            .agg(F.min(F.struct("dist", "a", "b")).alias("e")).select("ca", "cb", "e.*"),
            "tree-edges",
        )
    if count:
        picked, ended = _finish(rest.filter("ca < cb").toArrow())
        found.append(spark.createDataFrame(picked, "a long, b long, dist double"))
        parts = moved(parts, spark.createDataFrame(ended, "node long, up long"))
    parts = materialize(parts, "tree-parts")
    heads = parts.select("part").distinct()
    tree = heads.crossJoin(F.broadcast(heads.agg(F.min("part").alias("a")))).filter("part <> a").select(
        "a", F.col("part").alias("b"), F.lit(float("inf")).alias("dist")
    )
    for edges in found:
        tree = tree.unionByName(edges)
    return materialize(tree, "spanning-tree"), parts


def _finish(rows) -> tuple[pa.Table, pa.Table]:
    """The tree's edges among few components, and the components in which these end."""
    ca, cb, a, b = (rows[c].to_numpy() for c in ("ca", "cb", "a", "b"))
    dist = rows["dist"].to_numpy()
    names, ends = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    x, y = ends[: len(ca)].tolist(), ends[len(ca):].tolist()
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    picked = []
    for e in np.lexsort((b, a, dist)).tolist():
        i, j = find(x[e]), find(y[e])
        if i != j:
            root[max(i, j)] = min(i, j)
            picked.append(e)
    ended = names[[find(i) for i in range(len(names))]]
    return pa.table({"a": a[picked], "b": b[picked], "dist": dist[picked]}), pa.table({"node": names, "up": ended})


def _roots(pointers: DataFrame) -> DataFrame:
    """Every node with the root of its component, (node, up).

    With distinct weights the only cycles are two nodes that point to each other; the smaller
    of the two is the root. Pointers double their reach each step.
    """
    other = pointers.select(F.col("node").alias("up"), F.col("up").alias("back"))
    mutual = (F.col("back") == F.col("node")) & (F.col("node") < F.col("up"))
    current = materialize(
        hot_join(pointers, other, ["up"])
        .select("node", F.when(mutual, F.col("node")).otherwise(F.col("up")).alias("up")),
        "pointers",
    )
    while True:
        above = current.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = materialize(
            hot_join(current, above, ["up"])
            .select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")),
            "pointers",
        )
        current = jumped.select("node", "up")
        if jumped.filter("moved").isEmpty():
            return current
