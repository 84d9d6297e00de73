"""Clusters of greatest stability from the edges of a spanning tree.

The edges are read by rising distance. Parts of the data that they join are small at first;
a part of ``min_size`` rows is born as a cluster, small parts that a cluster meets fall into it,
and where clusters meet they end and a parent of them is born. All edges of one distance count
at once, so ties do not depend on any order. When a cluster ends, its stability (what its rows
gained in 1 / distance) is compared with the best choice among the clusters it was born from;
rows belong to the outermost chosen cluster that holds them.

Edges come to the driver in chunks of bounded size, and each chunk goes back as a table of what
became of the parts it touched. A distance with more edges than a chunk is settled by Spark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from topicloom.operators.components import connected_components
from topicloom.scratch import materialize
from topicloom.skew import hot_join, hot_keys, join_apart

CHUNK_EDGES = 500_000
#: Shorter distances count as this one.
LEAST = 1e-12

STATE = ["size", "cluster", "lam", "kids"]
MOVES = pa.schema([
    ("part", pa.int64()), ("new", pa.int64()), ("size", pa.int64()), ("cluster", pa.string()),
    ("lam", pa.float64()), ("kids", pa.float64()), ("fell", pa.string()),
])
CLOSED = pa.schema([("cluster", pa.string()), ("parent", pa.string()), ("chosen", pa.bool_())])


def condensed_labels(
    tree: DataFrame, weights: DataFrame, min_size: int, chunk_edges: int = CHUNK_EDGES
) -> DataFrame:
    """(vid, cluster): the chosen cluster of each vector, NULL for noise.

    ``tree`` is a written spanning tree (a, b, dist), ``weights`` is (vid, copies). A vector
    with ``min_size`` copies is a cluster by itself, whose rows count from its first edge on.
    All of the data together are never a cluster.
    """
    spark = tree.sparkSession
    longest = tree.filter(F.col("dist") < float("inf")).agg(F.max("dist")).first()[0]
    heavy = F.when(F.col("copies") >= min_size, F.concat(F.col("vid").cast("string"), F.lit("h")))
    start = weights.select(
        F.col("vid").alias("part"), F.col("copies").cast("long").alias("size"), heavy.alias("cluster"),
        F.lit(None).cast("double").alias("lam"), F.lit(0.0).alias("kids"),
    )
    edges = tree.toDF("a", "b", "dist")
    for end in "ab":
        own = start.select(F.col("part").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in STATE])
        edges = edges.join(own, end)
    edges = materialize(edges, "condense-edges")
    points = start.select(
        F.col("part").alias("vid"), "part", F.col("cluster").alias("fell")
    )
    closed = []
    for low, high, n in _chunks(tree, tree.count(), chunk_edges):
        inside = edges.filter((F.col("dist") > low) & (F.col("dist") <= high))
        if n <= chunk_edges:
            rows = inside.toArrow().sort_by([(c, "ascending") for c in ("dist", "a", "b")])
            moves, ended = _merge(rows, min_size, longest)
            moves = materialize(spark.createDataFrame(moves), "moves")
            closed.append(spark.createDataFrame(ended))
        else:
            moves, ended = _merge_tied(inside, min_size, _gain(high, longest))
            closed.append(ended)
        rest = edges.filter(F.col("dist") > high)
        last = rest.isEmpty()
        points = _follow(points, moves)
        if not last:
            points = materialize(points, "condense-points")
            edges = materialize(_advance(rest, moves), "condense-edges")
    if not closed:
        return points.select("vid", F.lit(None).cast("string").alias("cluster"))
    for other in closed[1:]:
        closed[0] = closed[0].unionByName(other)
    labels = _outermost(materialize(closed[0], "closed-clusters"))
    points = materialize(points.select("vid", F.col("fell").alias("cluster")), "fallen")
    return hot_join(points, labels, ["cluster"], how="left").select("vid", F.col("label").alias("cluster"))


def _gain(distance: float, longest: float | None) -> float:
    return 1.0 / max(min(distance, distance if longest is None else longest), LEAST)


def _chunks(tree: DataFrame, n: int, most: int) -> Iterator[tuple[float, float, int]]:
    """(low, high, edges) of rising distance intervals, low excluded; more than ``most`` edges
    only where an interval holds a single distance."""
    todo = [(-1.0, float("inf"), n)] if n else []
    while todo:
        low, high, count = todo.pop()
        if count <= most:
            yield low, high, count
            continue
        inside = tree.filter((F.col("dist") > low) & (F.col("dist") <= high))
        row = inside.agg(
            F.percentile_approx("dist", 0.5).alias("middle"), F.max("dist").alias("top"), F.min("dist").alias("least")
        ).first()
        if row["top"] == row["least"]:
            yield low, high, count
            continue
        cut = row["middle"]
        if cut >= row["top"]:
            cut = inside.filter(F.col("dist") < row["top"]).agg(F.max("dist")).first()[0]
        below = inside.filter(F.col("dist") <= cut).count()
        todo += [(cut, high, count - below), (low, cut, below)]


def _settle(states, olds, new: int, gain: float, min_size: int, closed: list) -> tuple[list, str | None]:
    """State of the part that ``olds`` form, and the cluster into which small ones fall."""
    size = sum(states[o][0] for o in olds)
    clusters = [o for o in olds if states[o][1] is not None]
    for o in clusters:
        if states[o][2] is None:
            states[o][2] = states[o][0] * gain
    # Every part but the smallest id ends here, each of them only once.
    name = f"{min(o for o in olds if o != new)}m"
    if not clusters:
        state = [size, name if size >= min_size else None, size * gain, 0.0]
    elif len(clusters) == 1:
        _, cluster, lam, kids = states[clusters[0]]
        state = [size, cluster, lam + (size - states[clusters[0]][0]) * gain, kids]
    else:
        best = 0.0
        for o in sorted(clusters):
            own, cluster, lam, kids = states[o]
            stability = lam - own * gain
            closed.append((cluster, name, stability >= kids))
            best += max(stability, kids)
        state = [size, name, size * gain, best]
    return state, state[1]


def _merge(rows: pa.Table, min_size: int, longest: float | None) -> tuple[pa.Table, pa.Table]:
    """What becomes of the parts that a chunk of edges joins, and the clusters that end there."""
    columns = {
        c: rows[c].to_pylist() if rows[c].null_count else rows[c].to_numpy().tolist() for c in rows.column_names
    }
    a, b, dist = columns["a"], columns["b"], columns["dist"]
    states: dict[int, list] = {}
    for end, ids in (("a", a), ("b", b)):
        states.update(zip(ids, map(list, zip(*[columns[f"{end}_{c}"] for c in STATE]))))
    small = [p for p, s in states.items() if s[1] is None]
    known = list(states)
    root = {p: p for p in states}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    into: dict[int, int] = {}
    fell: dict[int, str] = {}
    closed: list[tuple] = []
    i = 0
    while i < len(dist):
        j = i + 1
        while j < len(dist) and dist[j] == dist[i]:
            j += 1
        if j == i + 1:
            x, y = find(a[i]), find(b[i])
            size = states[x][0] + states[y][0]
            if x != y and size < min_size and states[x][1] is None and states[y][1] is None:
                # Most edges join two small parts to a small one.
                new, old = min(x, y), max(x, y)
                root[old] = into[old] = new
                states[new] = [size, None, size * _gain(dist[i], longest), 0.0]
                i = j
                continue
        met = {find(p) for e in range(i, j) for p in (a[e], b[e])}
        for e in range(i, j):
            x, y = find(a[e]), find(b[e])
            root[max(x, y)] = min(x, y)
        groups = defaultdict(list)
        for p in met:
            groups[find(p)].append(p)
        gain = _gain(dist[i], longest)
        for new, olds in groups.items():
            state, cluster = _settle(states, olds, new, gain, min_size, closed)
            for o in olds:
                if states[o][1] is None:
                    if cluster is not None:
                        fell[o] = cluster
                    elif o != new:
                        into[o] = new
            states[new] = state
        i = j

    def fate(p: int) -> str | None:
        while p not in fell and p in into:
            p = into[p]
        return fell.get(p)

    was_small = set(small)
    ends = [find(p) for p in known]
    sizes, clusters, lams, kids = zip(*[states[p] for p in ends])
    moves = [known, ends, sizes, clusters, lams, kids, [fate(p) if p in was_small else None for p in known]]
    ended = zip(*closed) if closed else [[] for _ in CLOSED]
    return tuple(
        pa.table([pa.array(c, f.type) for c, f in zip(values, schema)], schema=schema)
        for values, schema in ((moves, MOVES), (ended, CLOSED))
    )


def _merge_tied(edges: DataFrame, min_size: int, gain: float) -> tuple[DataFrame, DataFrame]:
    """As ``_merge``, by Spark, for edges of one distance."""
    end = lambda e: edges.select(F.col(e).alias("part"), *[F.col(f"{e}_{c}").alias(c) for c in STATE])
    parts = materialize(
        end("a").unionByName(end("b")).groupBy("part").agg(*[F.first(c).alias(c) for c in STATE]), "tied-parts"
    )
    group = F.lit(0).alias("group")
    found = connected_components(
        parts.select(group, F.col("part").alias("node")), edges.select(group, "a", "b"), "group"
    ).select(F.col("node").alias("part"), "component")
    big = F.col("cluster").isNotNull()
    grown = F.coalesce("lam", F.col("size") * gain)
    met = materialize(
        parts.join(found, "part").withColumn("lam", F.when(big, grown))
        .withColumn("stability", F.col("lam") - F.col("size") * gain),
        "tied-parts",
    )
    sums = materialize(
        met.groupBy("component").agg(
            F.min("part").alias("new"), F.sum("size").alias("all_size"), F.count("cluster").alias("clusters"),
            F.max("cluster").alias("only"), F.sum("lam").alias("all_lam"), F.sum(F.when(big, F.col("size"))).alias("big_size"),
            F.sum(F.when(big, F.col("kids"))).alias("all_kids"), F.sum(F.when(big, F.greatest("stability", "kids"))).alias("best"),
        ),
        "tied-sums",
    )
    met = materialize(hot_join(met, sums, ["component"]), "tied-parts")
    names = met.filter("part <> new").groupBy("component").agg(
        F.concat(F.min("part").cast("string"), F.lit("m")).alias("name")
    )
    met = materialize(hot_join(met, materialize(names, "tied-names"), ["component"]), "tied-parts")
    several, one = F.col("clusters") > 1, F.col("clusters") == 1
    cluster = F.when(one, F.col("only")).when(several | (F.col("all_size") >= min_size), F.col("name"))
    lam = F.when(one, F.col("all_lam") + (F.col("all_size") - F.col("big_size")) * gain).otherwise(F.col("all_size") * gain)
    kids = F.when(several, F.col("best")).when(one, F.col("all_kids")).otherwise(0.0)
    moves = met.select(
        "part", "new", F.col("all_size").alias("size"), cluster.alias("cluster"), lam.alias("lam"), kids.alias("kids"),
        F.when(~big, cluster).alias("fell"),
    )
    ended = met.filter(several & big).select(
        "cluster", F.col("name").alias("parent"), (F.col("stability") >= F.col("kids")).alias("chosen")
    )
    return materialize(moves, "tied-moves"), ended


def _follow(points: DataFrame, moves: DataFrame) -> DataFrame:
    """Points that have not fallen into a cluster yet go with their part."""
    changed = moves.select("part", "new", F.col("fell").alias("now"))
    return points.join(changed, "part", "left").select(
        "vid", F.coalesce("new", "part").alias("part"), F.coalesce("fell", "now").alias("fell")
    )


def _advance(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges between the parts as they are now."""
    # Counted before the joins; the join at one end leaves the other as it is.
    total = edges.count()
    hot = {end: hot_keys(edges, [end], total=total) for end in "ab"}
    for end in "ab":
        changed = moves.select(
            F.col("part").alias(end), F.col("new").alias("_new"), *[F.col(c).alias(f"_{c}") for c in STATE]
        )
        known = F.col("_new").isNotNull()
        edges = join_apart(edges, changed, [end], hot[end], how="left").select(
            *[c for c in edges.columns if not c.startswith(f"{end}_") and c != end],
            F.coalesce("_new", end).alias(end),
            *[F.when(known, F.col(f"_{c}")).otherwise(F.col(f"{end}_{c}")).alias(f"{end}_{c}") for c in STATE],
        )
    return edges


def _outermost(closed: DataFrame) -> DataFrame:
    """(cluster, label): the outermost chosen cluster around each cluster, itself included."""
    current = closed.select(
        "cluster", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cluster")).alias("label")
    )
    while True:
        above = current.select(
            F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("label").alias("outer")
        )
        current = materialize(
            current.join(above, "up", "left").select(
                "cluster", F.col("next").alias("up"), F.coalesce("outer", "label").alias("label")
            ),
            "outermost",
        )
        if current.filter("up IS NOT NULL").isEmpty():
            return current.filter("label IS NOT NULL").select("cluster", "label")
