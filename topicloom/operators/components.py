"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from topicloom.scratch import materialize
from topicloom.skew import hot_join, hot_keys, join_apart


def _scramble(c: Column) -> Column:
    """A bijection on longs, so that neighbouring ids do not form long descending chains."""
    for left, shift in ((True, 13), (False, 7), (True, 17)):
        moved = F.shiftleft(c, shift) if left else F.shiftrightunsigned(c, shift)
        c = c.bitwiseXOR(moved)
    return c


def connected_components(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(group, node, component) for many graphs at once, one per value of ``group``.

    ``nodes`` is (group, node), ``edges`` is (group, a, b) in any direction. Each round every
    node points to its smallest neighbour, the pointers are shortened, and the graph is
    contracted along them, so the edge list shrinks quickly. The pointers of all rounds are
    composed from the last and smallest to the first. Component ids are opaque.
    """
    pairs = edges.select(group, _scramble(F.col("a")).alias("a"), _scramble(F.col("b")).alias("b"))
    pairs = pairs.filter("a <> b")
    pairs = materialize(
        pairs.union(pairs.select(group, "b", "a")).distinct(), "component-edges"
    )
    pointers: list[DataFrame] = []
    while count := pairs.count():
        parent = materialize(
            pairs.groupBy(group, "a").agg(F.min("b").alias("low"))
            .select(group, F.col("a").alias("node"), F.least("a", "low").alias("up")),
            "parents",
        )
        above = parent.select(group, F.col("node").alias("up"), F.col("up").alias("top"))
        parent = materialize(
            hot_join(parent, above, [group, "up"])
            .select(group, "node", F.col("top").alias("up")),
            "parents",
        )
        pointers.append(parent)
        # Both directions of each edge are present, so both ends have the same hot nodes.
        hot = hot_keys(pairs, [group, "a"], total=count)
        a = parent.select(group, F.col("node").alias("a"), F.col("up").alias("pa"))
        b = parent.select(group, F.col("node").alias("b"), F.col("up").alias("pb"))
        joined = join_apart(join_apart(pairs, a, [group, "a"], hot), b, [group, "b"], hot)
        pairs = materialize(
            joined.select(group, F.col("pa").alias("a"), F.col("pb").alias("b"))
            .filter("a <> b").distinct(),
            "component-edges",
        )
    start = nodes.select(group, "node", _scramble(F.col("node")).alias("component"))
    if not pointers:
        return start
    roots = pointers.pop()
    while pointers:
        later = roots.select(group, F.col("node").alias("up"), F.col("up").alias("root"))
        # A pointer to a node that later rounds no longer mention is final.
        roots = materialize(
            hot_join(pointers.pop(), later, [group, "up"], how="left")
            .select(group, "node", F.coalesce("root", "up").alias("up")),
            "roots",
        )
    found = roots.select(group, F.col("node").alias("component"), "up")
    return materialize(
        start.join(found, [group, "component"], "left")
        .select(group, "node", F.coalesce("up", "component").alias("component")),
        "components",
    )
