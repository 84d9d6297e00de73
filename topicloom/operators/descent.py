"""Approximate neighbour lists by neighbour-of-neighbour descent, for vectors without structure.

The exact search rules out cells by distance bounds, which fails where all distances are alike.
Descent starts from lists within groups that lie on the same sides of random planes and improves
them: the neighbours of a row, and the rows that it is a neighbour of, are compared with each
other, because a neighbour's neighbour is likely to be one. Rounds go on until hardly any list
changes. Rows are compared in parts of many rows, and a vector travels once to a part, in single
precision; distances of the last lists are computed from the vectors as given. A round moves a
vector to at most ``2 * pool`` parts, so the work grows with the rows and not with their square.
The result is approximate; ``recall`` measures it against the exact lists.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from topicloom.operators.neighbors import TIE_DIGITS, _nearest_function, _visit_kernel
from topicloom.scratch import materialize

# Rows of a group of the start, groups in which a row starts, and rows by which planes are placed.
START_ROWS, START_GROUPS, PLACED_ROWS = 3_000, 8, 2_000
# Planes of a start; larger groups are split by hash.
MAX_PLANES = 14
# Parts of a round, and numbers that a part's vectors may hold. Vectors that exceed these in all have more parts.
LEAST_PARTS, PART_VALUES = 16, 1 << 26
# Pairs that a part holds before it keeps the best of them.
HELD_PAIRS = 4_000_000
EDGE = "vid long, nbr long, dist double"


class NotSettled(RuntimeError):
    """Lists still change after the allowed rounds."""


def _best(edges: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("vid").orderBy(F.round("dist", TIE_DIGITS), "nbr")
    return edges.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= most).drop("i")


def _merged(edges: DataFrame, most: int) -> DataFrame:
    """The best of ``edges`` (vid, nbr, dist, fresh), each pair once; known pairs are not fresh."""
    # Laid out by vid, so that both steps need no other shuffle. A row has a bounded number of edges.
    once = edges.repartition("vid").groupBy("vid", "nbr").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    return _best(once, most)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _edges(vid: np.ndarray, nbr: np.ndarray, dist: np.ndarray) -> pa.Table:
    return pa.table({"vid": pa.array(vid, pa.int64()), "nbr": pa.array(nbr, pa.int64()), "dist": pa.array(dist, pa.float64())})


def _deal(planes: np.ndarray, cuts: np.ndarray):
    """A row for each vector and start, with the sides of the start's planes on which it lies."""

    def run(batches):
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column(1)]))
            for start in range(len(planes)):
                sides = x @ planes[start].T > cuts[start]
                leaf = sides @ (1 << np.arange(sides.shape[1]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(np.full(len(x), start), pa.int32()), pa.array(leaf, pa.int32()),
                ], names=["vid", "vec", "start", "leaf"])

    return run


def _within(pool: int, metric: str):
    nearest = _nearest_function(pool, metric)

    def kernel(rows: pa.Table) -> pa.Table:
        ids, x = rows["vid"].to_numpy(), _matrix(rows["vec"]).astype(np.float64)
        r, c, d = nearest(x, ids, x, ids)
        return _edges(ids[r], ids[c], d)

    return kernel


def _start(vectors: DataFrame, total: int, pool: int, metric: str) -> DataFrame:
    """The nearest rows in groups that share the sides of random planes, ``START_GROUPS`` times."""
    bits = min(MAX_PLANES, max(0, ceil(log2(total / START_ROWS))))
    picked = vectors.orderBy(F.xxhash64("vid"), "vid").limit(PLACED_ROWS).select("vec").collect()
    sample = np.array([r[0] for r in picked], dtype=np.float64)
    planes = np.random.default_rng(0).normal(size=(START_GROUPS if bits else 1, bits, sample.shape[1]))
    cuts = np.array([np.median(sample @ p.T, axis=0) for p in planes])
    dealt = vectors.mapInArrow(_deal(planes, cuts), "vid long, vec array<float>, start int, leaf int")
    # Planes cannot tell apart rows that are alike; what is left of large groups is dealt by hash.
    sizes = dealt.groupBy("start", "leaf").agg(F.ceil(F.count("*") / (2 * START_ROWS)).alias("blocks"))
    placed = dealt.join(materialize(sizes, "start-groups"), ["start", "leaf"]).withColumn(
        "block", F.pmod(F.xxhash64("vid", "start"), F.col("blocks"))
    )
    found = placed.select("vid", "vec", "start", "leaf", "block").groupBy("start", "leaf", "block").applyInArrow(
        _within(pool, metric), EDGE
    )
    return _merged(found.withColumn("fresh", F.lit(True)), pool)


def _hubs(graph: DataFrame, vectors: DataFrame, pool: int, number: int, part: Column) -> DataFrame:
    """(part, members, fresh): the rows to be compared with each other, where any is fresh."""
    # A row may be the neighbour of any number of rows; this round it stands for these.
    crowd = Window.partitionBy("hub").orderBy(F.desc("fresh"), F.xxhash64(F.lit(number), "hub", "vid"))
    back = (
        graph.select(F.col("nbr").alias("hub"), "vid", "fresh")
        .withColumn("i", F.row_number().over(crowd)).filter(F.col("i") <= pool).drop("i")
    )
    forth = graph.select(F.col("vid").alias("hub"), F.col("nbr").alias("vid"), "fresh")
    self_ = vectors.select(F.col("vid").alias("hub"), "vid", F.lit(False).alias("fresh"))
    every = forth.unionByName(back).unionByName(self_).repartition("hub")
    return (
        every.groupBy("hub", "vid").agg(F.max("fresh").alias("fresh"))
        .groupBy("hub").agg(
            F.max("fresh").alias("any"), F.collect_list("vid").alias("members"), F.collect_list("fresh").alias("fresh")
        )
        .filter("any").select(part.alias("part"), "members", "fresh")
    )


def _compare(metric: str, pool: int):
    """New pairs among the members of each hub that can improve a list, the best of each row.

    ``known`` holds 16-bit tags of a row's neighbours, which differ between rounds.
    """

    def kernel(hubs: pa.Table, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["vid"].to_numpy())
        ids, tag, bound = (rows[c].to_numpy()[order] for c in ("vid", "tag", "bound"))
        x = _matrix(rows["vec"])[order]
        known = rows["known"].combine_chunks()
        width = np.diff(known.offsets.to_numpy())
        tags = np.full((len(ids), pool), -1, np.int32)
        tags[np.repeat(np.arange(len(ids)), width), np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)] = known.flatten().to_numpy()
        tags = tags[order]
        bound = bound.copy()
        members = hubs["members"].combine_chunks()
        ends = members.offsets.to_numpy() - members.offsets[0].as_py()
        at = np.searchsorted(ids, members.flatten().to_numpy())
        fresh = hubs["fresh"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        found, held = [], 0

        def kept(found):
            r, c, d = (np.concatenate(a) for a in zip(*found))
            _, once = np.unique(r * len(ids) + c, return_index=True)
            r, c, d = r[once], c[once], d[once]
            new = np.concatenate([
                ~(tags[r[s:s + 500_000]] == tag[c[s:s + 500_000], None]).any(1) for s in range(0, len(r), 500_000)
            ]) if len(r) else np.zeros(0, bool)
            r, c, d = r[new], c[new], d[new]
            by = np.lexsort((c, np.round(d, TIE_DIGITS), r))
            r, c, d = r[by], c[by], d[by]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            last = rank == pool - 1
            bound[r[last]] = np.minimum(bound[r[last]], d[last])
            best = rank < pool
            return [(r[best], c[best], d[best])]

        for hub in range(len(members)):
            part = slice(ends[hub], ends[hub + 1])
            own, new = at[part], fresh[part]
            p = x[own].astype(np.float64)
            if metric == "cosine":
                d = 1.0 - p @ p.T
            else:
                d = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(2))
            useful = (new[:, None] | new[None, :]) & (d <= bound[own][:, None] + 10.0 ** -TIE_DIGITS)
            np.fill_diagonal(useful, False)
            r, c = np.nonzero(useful)
            found.append((own[r], own[c], d[r, c]))
            held += len(r)
            if held > HELD_PAIRS:
                found = kept(found)
                held = len(found[0][0])
        r, c, d = kept(found)[0] if found else (np.zeros(0, np.int64),) * 3
        return _edges(ids[r], ids[c], d)

    return kernel


def _exact(metric: str):
    """Distances of the pairs of a part from its vectors."""

    def kernel(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["vid"].to_numpy())
        ids, x = rows["vid"].to_numpy()[order], _matrix(rows["vec"])
        a, b = pairs["vid"].to_numpy(), pairs["nbr"].to_numpy()
        left, right = (order[np.searchsorted(ids, v)] for v in (a, b))
        dist = np.empty(len(a))
        for start in range(0, len(a), 100_000):
            at = slice(start, start + 100_000)
            p, q = x[left[at]], x[right[at]]
            if metric == "cosine":
                dist[at] = 1.0 - (p * q).sum(1)
            else:
                dist[at] = np.sqrt(((p - q) ** 2).sum(1))
        return _edges(a, b, dist)

    return kernel


def descent_neighbors(
    distinct: DataFrame, k: int, metric: str = "cosine", pool: int | None = None,
    settled: float = 0.001, rounds: int = 30,
) -> DataFrame:
    """(vid, nbr, dist): about the k nearest other vectors of each vector, as a written table.

    ``distinct`` is a written table (vid, vec), of unit length for ``metric="cosine"``. Lists hold
    ``pool`` entries (2 * k, at least 30) during the descent. It ends once a round changes at most
    the share ``settled`` of all entries; ``NotSettled`` is raised where ``rounds`` don't suffice.
    Rounds of hash order decide which rows a crowded row stands for, so reruns agree.
    """
    pool = max(30, 2 * k) if pool is None else max(pool, k)
    total = distinct.count()
    if total < 2:
        return distinct.sparkSession.createDataFrame([], EDGE)
    width = len(distinct.select("vec").first()[0])
    vectors = materialize(distinct.select("vid", F.col("vec").cast("array<float>").alias("vec")), "descent-vectors")
    values = total * max(1, width)
    parts = LEAST_PARTS if values <= PART_VALUES else max(LEAST_PARTS, -(-values * (2 * pool + 1) // PART_VALUES))
    part = lambda c: F.pmod(F.xxhash64(F.lit(11), c), F.lit(parts)).cast("int")
    graph = materialize(_start(vectors, total, pool, metric), "descent")
    for number in range(rounds):
        hubs = materialize(_hubs(graph, vectors, pool, number, part("hub")), "descent-hubs")
        tag = lambda c: F.pmod(F.xxhash64(F.lit(number), c), F.lit(1 << 16)).cast("int")  # noqa: B023, E731
        lists = graph.groupBy("vid").agg(
            F.when(F.count("*") >= pool, F.max(F.round("dist", TIE_DIGITS))).otherwise(float("inf")).alias("bound"),
            F.collect_list(tag("nbr")).alias("known"),
        )
        # Renamed, because both sides of a cogroup must not share columns.
        wanted = hubs.select(F.col("part").alias("part"), F.explode("members").alias("vid")).distinct()
        rows = wanted.join(vectors, "vid").join(lists, "vid", "left").select(
            "part", "vid", "vec", tag("vid").alias("tag"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"),
            F.coalesce("known", F.array().cast("array<int>")).alias("known"),
        )
        found = hubs.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(_compare(metric, pool), EDGE)
        graph = materialize(
            _merged(graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), pool), "descent"
        )
        if graph.filter("fresh").count() <= settled * total * min(pool, total - 1):
            break
    else:
        raise NotSettled(f"neighbour lists still change after {rounds} rounds")
    pairs = graph.select(part("vid").alias("part"), "vid", "nbr")
    wanted = pairs.select(F.col("part").alias("part"), F.explode(F.array("vid", "nbr")).alias("vid")).distinct()
    rows = wanted.join(distinct.select("vid", "vec"), "vid").select("part", "vid", "vec")
    exact = pairs.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(_exact(metric), EDGE)
    return materialize(_best(exact, k), "descent-nearest")


def recall(
    distinct: DataFrame, found: DataFrame, k: int, metric: str = "cosine", every: int = 100,
    block_rows: int = 4_000,
) -> float:
    """Share of the exact k nearest that ``found`` has, over vectors whose vid ``every`` divides.

    These are compared with all vectors, block by block. Equal distances count alike.
    """
    queries = materialize(distinct.filter(F.col("vid") % every == 0).select("vid", "vec"), "recall-queries")
    asked, total = queries.count(), distinct.count()
    if not asked or total < 2:
        return 1.0
    lanes, blocks = max(1, -(-asked // block_rows)), max(1, -(-total // block_rows))
    lane = F.pmod(F.xxhash64("vid"), F.lit(lanes))
    left = queries.select("vid", "vec", lane.alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = distinct.select(
        F.col("vid").alias("point"), F.col("vec").alias("at"),
        F.pmod(F.xxhash64(F.lit(3), "vid"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"),
    )
    exact = left.groupBy("block", "lane").cogroup(right.groupBy("block", "lane")).applyInPandas(
        _visit_kernel(k, metric), EDGE
    )
    limits = _best(exact, k).groupBy("vid").agg(
        F.max(F.round("dist", TIE_DIGITS)).alias("limit"), F.count("*").alias("wanted")
    )
    hits = found.join(limits, "vid").filter(F.round("dist", TIE_DIGITS) <= F.col("limit"))
    per = limits.join(hits.groupBy("vid").agg(F.count("*").alias("hits")), "vid", "left")
    return per.agg(F.sum(F.coalesce("hits", F.lit(0))) / F.sum("wanted")).first()[0]
