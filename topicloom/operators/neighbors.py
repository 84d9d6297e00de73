"""Exact k-nearest-neighbour graphs by cells with distance bounds.

Copies of a vector are collapsed first, so any number of equal rows costs one search. The
distinct vectors fall into cells around pivots; a vector only visits cells that its current
k-th distance cannot rule out by the triangle inequality. Cells and visits are split into
blocks of bounded size, so no task ever holds a whole cell, and a block only returns the k
best candidates per vector. Neighbouring cells are visited as one bundle: a vector travels once to
a bundle and not to each of its cells, and meets the rows of the cells that it has to visit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from topicloom.functions.vectors import unit
from topicloom.operators.projection import neighbor_count
from topicloom.scratch import materialize
from topicloom.skew import hot_join

# Rounding that decides ties between distances; the smaller id then comes first.
TIE_DIGITS = 9
SLACK = 1e-6
# Rows whose visits are listed at a time.
VISIT_ROWS = 500
# Distances held at a time; they stay in a core's cache.
STEP_VALUES = 1 << 18


@dataclass(frozen=True)
class SearchSize:
    """Bounds of one search. Pivots are a hashed sample, so dense regions get more of them."""

    cell_rows: int = 2_000
    block_rows: int = 4_000
    bundle_rows: int = 16_000
    bundle_values: int = 8_000_000
    max_pivots: int = 65_536
    max_pivot_values: int = 4_000_000


def collapse_copies(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (row_id, vid, copies) and distinct vectors (vid, vec, copies) as written tables.

    ``vid`` is the smallest row_id among equal vectors, told apart by a 128-bit digest.
    """
    keyed = vectors.select(
        "row_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(17), "vec").alias("h2")
    )
    keys = materialize(keyed.select("row_id", "h1", "h2"), "vector-keys")
    groups = materialize(
        keys.groupBy("h1", "h2").agg(F.min("row_id").alias("vid"), F.count("*").alias("copies")),
        "copy-groups",
    )
    members = materialize(
        hot_join(keys, groups, ["h1", "h2"]).select("row_id", "vid", "copies"), "members"
    )
    distinct = materialize(
        keyed.select(F.col("row_id").alias("vid"), "vec")
        .join(groups.select("vid", "copies"), "vid"),
        "distinct-vectors",
    )
    return members, distinct


def neighbors_of_distinct(
    distinct: DataFrame, k: int, metric: str = "cosine", size: SearchSize = SearchSize(),
) -> DataFrame:
    """(vid, nbr, dist): the k nearest other vectors of each vector, as a written table.

    For ``metric="cosine"`` the vectors must have unit length.
    """
    total = distinct.count()
    if total < 2:
        return distinct.sparkSession.createDataFrame([], "vid long, nbr long, dist double")
    width = len(distinct.select("vec").first()[0])
    n_pivots = max(1, min(
        size.max_pivots, size.max_pivot_values // max(1, width), -(-total // size.cell_rows)
    ))
    picked = distinct.orderBy(F.xxhash64("vid"), "vid").limit(n_pivots).select("vec").collect()
    pivots = np.array([r[0] for r in picked], dtype=np.float64)

    # Cell of each vector and its distance to the pivot.
    cells = materialize(
        distinct.select("vid", "vec").mapInPandas(
            _cell_kernel(pivots), "vid long, vec array<double>, cell int, home double"
        ),
        "cells",
    )
    stats = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("r")).collect()
    count = np.zeros(n_pivots, dtype=np.int64)
    radius = np.zeros(n_pivots)
    for row in stats:
        count[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    blocks = np.maximum(1, -(-count // size.block_rows))

    # Search inside the own block, which also gives the bound that picks further cells.
    plan = _per_cell(cells, blocks=blocks)
    blocked = cells.join(plan, "cell").withColumn("block", _pmod(F.xxhash64("vid"), "blocks"))
    own = materialize(
        blocked.select("vid", "vec", "cell", "block").groupBy("cell", "block").applyInPandas(
            _own_block_kernel(pivots, count, radius, blocks, k, metric),
            "vid long, vec array<double>, cell int, block long, "
            "nbrs array<long>, dists array<double>, targets array<int>",
        ),
        "own-blocks",
    )
    edges = own.select(
        "vid", F.explode(F.arrays_zip("nbrs", "dists")).alias("e")
    ).select("vid", F.col("e.nbrs").alias("nbr"), F.col("e.dists").alias("dist"))

    rows = max(1, min(size.bundle_rows, size.bundle_values // max(1, width)))
    bundle = _bundles(pivots, count, blocks, rows)
    load = np.zeros(int((bundle + blocks).max()), dtype=np.int64)
    loads = own.select("cell", "block", "targets").mapInArrow(_loads(bundle, blocks), "bundle int, n long")
    for row in loads.groupBy("bundle").agg(F.sum("n").alias("n")).collect():
        load[row["bundle"]] = row["n"]
    if load.any():
        lanes = np.maximum(1, -(-load // rows))
        limit = F.when(F.size("dists") >= k, F.round(F.element_at("dists", -1), TIE_DIGITS))
        lane_plan = _per_cell(cells, lanes=lanes, load=load).withColumnRenamed("cell", "bundle")
        queries = (
            own.select("vid", "vec", limit.alias("limit"), "cell", "block", "targets")
            .mapInArrow(_visits(bundle, blocks), "vid long, vec array<double>, limit double, bundle int, cells array<int>, own int")
            .join(lane_plan, "bundle")
            .select("vid", "vec", "limit", "cells", "own", "bundle", _pmod(F.xxhash64("vid", F.lit(5)), "lanes").alias("lane"))
        )
        # Renamed, because both sides stem from one table and must not share columns.
        at = (F.col("bundle") + F.col("block")).cast("int").alias("bundle")
        points = own.join(_per_cell(cells, bundle=bundle), "cell").select("vid", "vec", "cell", at).join(
            lane_plan.filter("load > 0"), "bundle"
        ).select(
            F.col("vid").alias("point"), F.col("vec").alias("at"), F.col("cell").alias("cell"), F.col("bundle").alias("bundle"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"),
        )
        on = ["bundle", "lane"]
        edges = edges.union(
            queries.groupBy(*on).cogroup(points.groupBy(*on)).applyInPandas(
                _bundle_kernel(k, metric), "vid long, nbr long, dist double"
            )
        )
    nearest = Window.partitionBy("vid").orderBy(F.round("dist", TIE_DIGITS), "nbr")
    return materialize(
        edges.withColumn("i", F.row_number().over(nearest)).filter(F.col("i") <= k).drop("i"),
        "nearest",
    )


def knn_graph(
    vectors: DataFrame, k: int | None = None, metric: str = "cosine", vec_col: str = "embedding",
    size: SearchSize = SearchSize(), search: Callable[[DataFrame, int, str], DataFrame] | None = None,
) -> DataFrame:
    """(row_id, nbr_id, rank, dist): the k nearest other rows of each row, ties by id.

    ``k`` defaults to min(15, max(2, n / 3)). ``search`` replaces the exact search of the distinct
    vectors, for example by ``descent.descent_neighbors`` for vectors without structure.
    """
    rows = vectors.select("row_id", F.col(vec_col).cast("array<double>").alias("vec"))
    if metric == "cosine":
        rows = rows.withColumn("vec", unit(F.col("vec")))
    members, distinct = collapse_copies(rows)
    if k is None:
        k = members.agg(neighbor_count(F.count("*")).alias("k")).first()["k"]
    edges = neighbors_of_distinct(distinct, k, metric, size) if search is None else search(distinct, k, metric)

    # Of each group of copies, k + 1 rows are enough to serve any neighbour list.
    first = Window.partitionBy("vid").orderBy("row_id")
    leaders = materialize(
        members.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= k + 1)
        .groupBy("vid").agg(F.collect_list("row_id").alias("leaders")),
        "leaders",
    )
    within = distinct.select("vid", F.col("vid").alias("nbr"), F.lit(0.0).alias("dist"))
    reached = materialize(edges.unionByName(within), "reached")
    candidates = hot_join(reached, leaders.withColumnRenamed("vid", "nbr"), ["nbr"]).select(
        "vid", "dist", F.explode("leaders").alias("nbr_id")
    )
    nearest = Window.partitionBy("vid").orderBy(F.round("dist", TIE_DIGITS), "nbr_id")
    lists = materialize(
        candidates.withColumn("i", F.row_number().over(nearest)).filter(F.col("i") <= k + 1)
        .groupBy("vid")
        .agg(F.array_sort(F.collect_list(F.struct("i", "nbr_id", "dist"))).alias("near")),
        "neighbour-lists",
    )
    return hot_join(members.select("row_id", "vid"), lists, ["vid"]).select(
        "row_id", F.posexplode(F.slice(
            F.filter("near", lambda e: e["nbr_id"] != F.col("row_id")), 1, k
        ))
    ).select(
        "row_id", F.col("col.nbr_id").alias("nbr_id"), (F.col("pos") + 1).alias("rank"),
        F.greatest(F.col("col.dist"), F.lit(0.0)).alias("dist"),
    )


def _per_cell(cells: DataFrame, **values: np.ndarray) -> DataFrame:
    """Numbers per cell as a table; at most one row per pivot, so it can be broadcast."""
    table = pd.DataFrame({name: v.astype(np.int64) for name, v in values.items()})
    table.insert(0, "cell", np.arange(len(table), dtype=np.int32))
    return F.broadcast(cells.sparkSession.createDataFrame(table))


def _pmod(value: Column, n: str) -> Column:
    return F.pmod(value, F.col(n))


def _cell_kernel(pivots: np.ndarray):
    half = (pivots ** 2).sum(1) / 2

    def kernel(batches):
        for pdf in batches:
            x = np.stack(pdf["vec"].to_numpy())
            cell = np.zeros(len(x), dtype=np.int64)
            step = max(1, STEP_VALUES // len(pivots))
            for start in range(0, len(x), step):
                part = x[start:start + step]
                # The squared length of the row does not change which pivot is nearest.
                cell[start:start + step] = (half - part @ pivots.T).argmin(1)
            home = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pdf.assign(cell=cell.astype(np.int32), home=home)

    return kernel


def _rough_squares(q: np.ndarray, p: np.ndarray):
    """A function of a slice of ``q`` that gives squared distances to ``p`` by one product, and a
    bound of their error; no function where they may not be finite."""
    with np.errstate(over="ignore", invalid="ignore"):
        # Rows may come in single precision, and their distances are only as good as that.
        eps = float(np.finfo(np.result_type(q, p, np.float32)).eps)
        middle = p.mean(0, dtype=float)
        x, y = q - middle, p - middle
        xx, yy = (x ** 2).sum(1), (y ** 2).sum(1)
        error = 16 * eps * (x.shape[1] + 8) * (xx.max() + yy.max()) + np.finfo(float).tiny
    if not np.isfinite(error):
        return None, error
    left = np.column_stack([-2 * x, np.ones(len(x)), xx])
    right = np.column_stack([y, yy, np.ones(len(y))]).T
    return lambda part: left[part] @ right, error


def _nearest_function(k: int, metric: str):
    """Top-k search of one block: row indices, point indices and distances."""

    def distances(q, p):
        if metric == "cosine":
            return 1.0 - q @ p.T
        out = np.zeros((len(q), len(p)))
        for d in range(q.shape[1]):
            out += (q[:, d][:, None] - p[:, d][None, :]) ** 2
        return np.sqrt(out)

    def distances_of(q, p, r, c):
        """As ``distances``, of some pairs."""
        out = np.zeros(len(r))
        for d in range(q.shape[1]):
            out += (q[r, d] - p[c, d]) ** 2
        return np.sqrt(out)

    def first(r, c, d, p_ids, key):
        order = np.lexsort((p_ids[c], key, r))
        r, c, d = r[order], c[order], d[order]
        kept = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[kept], c[kept], d[kept]

    def nearest_by_squares(q, q_ids, p, p_ids, most, rough, error):
        """As ``nearest``; rough squares leave few pairs, whose distances are then exact."""
        found = []
        tie = 2 * 10.0 ** -TIE_DIGITS
        by_id = np.argsort(p_ids, kind="stable")
        same = np.searchsorted(p_ids[by_id], q_ids)
        copies = np.searchsorted(p_ids[by_id], q_ids, side="right") - same
        step = max(1, STEP_VALUES // max(1, len(p)))
        for start in range(0, len(q), step):
            part = slice(start, min(len(q), start + step))
            squares = rough(part)
            n = copies[part]
            own = np.repeat(np.arange(len(n)), n)
            at = np.repeat(same[part], n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            squares[own, by_id[at]] = np.inf
            if most is not None:
                limit = np.maximum(most[part], 0.0)
            elif len(p) > k:
                limit = np.sqrt(np.maximum(np.partition(squares, k - 1, axis=1)[:, k - 1], 0.0) + error)
            else:
                limit = np.full(len(squares), np.inf)
            # The greatest number leaves out the row itself.
            bound = np.minimum((limit + tie) ** 2 + error, np.finfo(float).max)
            r, c = np.nonzero(squares <= bound[:, None])
            d = distances_of(q[part], p, r, c)
            key = np.round(d, TIE_DIGITS)
            kept = np.isfinite(key) if most is None else key <= most[part][r]
            r, c, d, key = r[kept], c[kept], d[kept], key[kept]
            r, c, d = first(r, c, d, p_ids, key)
            found.append((r + start, c, d))
        return tuple(np.concatenate(x) for x in zip(*found))

    def nearest(q, q_ids, p, p_ids, most=None):
        """``most`` has a limit for each row, infinite where none is known; ties of it are in."""
        if most is not None and len(q) and np.isfinite(most).any() and not np.isfinite(most).all():
            known = np.isfinite(most)
            found = []
            for rows in (np.flatnonzero(known), np.flatnonzero(~known)):
                r, c, d = nearest(q[rows], q_ids[rows], p, p_ids, most[rows])
                found.append((rows[r], c, d))
            return tuple(np.concatenate(x) for x in zip(*found))
        close = most is not None and len(q) and np.isfinite(most).all()
        if metric != "cosine" and len(q) and len(p):
            rough, error = _rough_squares(q, p)
            if rough is not None:
                return nearest_by_squares(q, q_ids, p, p_ids, most if close else None, rough, error)
        rows, cols, dists = [], [], []
        step = max(1, (1 << 22) // max(1, len(p)))
        for start in range(0, len(q), step):
            part = slice(start, min(len(q), start + step))
            d = distances(q[part], p)
            if close:
                r, c = np.nonzero(d <= most[part][:, None] + 2 * 10.0 ** -TIE_DIGITS)
                key = np.round(d[r, c], TIE_DIGITS)
                kept = (key <= most[part][r]) & (q_ids[part][r] != p_ids[c])
                r, c, key = r[kept], c[kept], key[kept]
                order = np.lexsort((p_ids[c], key, r))
                r, c = r[order], c[order]
                kept = np.arange(len(r)) - np.searchsorted(r, r) < k
                rows.append(r[kept] + start)
                cols.append(c[kept])
                dists.append(d[r[kept], c[kept]])
                continue
            key = np.round(d, 9)
            key[q_ids[part][:, None] == p_ids[None, :]] = np.inf
            if len(p) > k:
                limit = np.partition(key, k - 1, axis=1)[:, k - 1]
            else:
                limit = np.full(len(d), np.finfo(float).max)
            r, c = np.nonzero((key <= limit[:, None]) & np.isfinite(key))
            order = np.lexsort((p_ids[c], key[r, c], r))
            r, c = r[order], c[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            kept = rank < k
            rows.append(r[kept] + start)
            cols.append(c[kept])
            dists.append(d[r[kept], c[kept]])
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)

    return nearest


def _own_block_kernel(pivots, count, radius, blocks, k: int, metric: str):
    nearest = _nearest_function(k, metric)
    between = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(2)) \
        if len(pivots) <= 256 else None
    slack, tie = SLACK, 10.0 ** -TIE_DIGITS

    def kernel(key, pdf):
        cell = int(key[0])
        x = np.stack(pdf["vec"].to_numpy())
        ids = pdf["vid"].to_numpy()
        r, c, d = nearest(x, ids, x, ids)
        ends = np.searchsorted(r, np.arange(len(x) + 1))
        # Euclidean bound on the k-th distance from the own block and from full cells.
        # Distances that tie after rounding are ordered by id, so the reach includes them.
        euclid = np.sqrt(np.maximum(2 * (d + tie), 0.0)) if metric == "cosine" else d + tie
        full = (ends[1:] - ends[:-1]) >= k
        bound = np.full(len(x), np.inf)
        bound[full] = euclid[ends[1:][full] - 1]
        nbrs = [ids[c[ends[i]:ends[i + 1]]] for i in range(len(x))]
        dists = [d[ends[i]:ends[i + 1]] for i in range(len(x))]
        to_own = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
        if between is not None:
            gaps = between[cell]
        else:
            gaps = np.sqrt(((pivots - pivots[cell]) ** 2).sum(1))
        # By rising reach from the own pivot; a step leaves out pivots beyond its last reach.
        far = to_own + bound
        order = np.argsort(far, kind="stable")
        targets = [None] * len(x)
        size = (pivots ** 2).sum(1)
        start = 0
        while start < len(x):
            rows = order[start:start + max(1, STEP_VALUES // len(pivots))]
            start += len(rows)
            open_slack = 4 * slack * (1 + gaps + to_own[rows].max())
            some = np.flatnonzero(~(gaps - radius > far[rows[-1]] + open_slack))
            part, gap = x[rows], gaps[some]
            to = np.sqrt(np.maximum(
                (part ** 2).sum(1)[:, None] - 2 * part @ pivots[some].T + size[some][None, :],
                0.0,
            ))
            near = np.where(count[some] > k, to + radius[some], np.inf).min(1)
            near = np.sqrt(near ** 2 + 2 * tie) if metric == "cosine" else near + tie
            reach = np.minimum(bound[rows], near)
            own = to_own[rows, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(gap > 0, (to ** 2 - own ** 2) / (2 * gap), 0.0)
            lower = np.maximum(to - radius[some], plane)
            open_ = (count[some] > 0) & (lower <= reach[:, None] + slack * (1 + to))
            open_[:, np.searchsorted(some, cell)] = blocks[cell] > 1
            for i, row in zip(rows.tolist(), open_):
                targets[i] = some[row].astype(np.int32)
        return pd.DataFrame({
            "vid": ids, "vec": pdf["vec"], "cell": cell, "block": pdf["block"],
            "nbrs": nbrs, "dists": dists, "targets": targets,
        })

    return kernel


def _bundles(pivots: np.ndarray, count: np.ndarray, blocks: np.ndarray, rows: int) -> np.ndarray:
    """First bundle of each cell. A cell of several blocks has one bundle for each; of the others,
    those whose pivots are near share one of about ``rows`` rows."""
    first, free = np.zeros(len(count), dtype=np.int64), 0
    single = np.flatnonzero(blocks == 1)
    open_ = [single] if len(single) else []
    while open_:
        part = open_.pop()
        if len(part) > 1 and count[part].sum() > rows:
            ordered = part[np.argsort(pivots[part, pivots[part].var(0).argmax()], kind="stable")]
            half = np.searchsorted(np.cumsum(count[ordered]), count[part].sum() / 2)
            half = min(max(1, int(half)), len(part) - 1)
            open_ += [ordered[half:], ordered[:half]]
        else:
            first[part] = free
            free += 1
    for cell in np.flatnonzero(blocks > 1):
        first[cell] = free
        free += int(blocks[cell])
    return first


def _units(batch: pa.RecordBatch, bundle: np.ndarray, blocks: np.ndarray):
    """Row, bundle and cell of every visit of a batch, by row and bundle; not to the row's own block."""
    targets = batch.column(batch.schema.get_field_index("targets"))
    cell = batch.column(batch.schema.get_field_index("cell")).to_numpy()
    block = batch.column(batch.schema.get_field_index("block")).to_numpy()
    target = targets.flatten().to_numpy()
    row = np.repeat(np.arange(len(targets)), np.diff(targets.offsets.to_numpy()))
    many = blocks[target]
    row, target = np.repeat(row, many), np.repeat(target, many)
    visit = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    kept = (target != cell[row]) | (visit != block[row])
    row, target, at = row[kept], target[kept], (bundle[target] + visit)[kept]
    order = np.lexsort((target, at, row))
    return row[order], at[order], target[order]


def _loads(bundle: np.ndarray, blocks: np.ndarray):
    """Number of rows that visit each bundle."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, VISIT_ROWS):
                row, at, _ = _units(whole.slice(start, VISIT_ROWS), bundle, blocks)
                pairs = np.unique(row * (int(bundle.max() + blocks.max()) + 1) + at)
                found, n = np.unique(pairs % (int(bundle.max() + blocks.max()) + 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64())], names=["bundle", "n"])

    return run


def _visits(bundle: np.ndarray, blocks: np.ndarray):
    """One row for each vector and bundle that it visits, with the cells to visit there, and its own
    cell if that is a single block, which may lie in a visited bundle."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, VISIT_ROWS):
                batch = whole.slice(start, VISIT_ROWS)
                row, at, cell = _units(batch, bundle, blocks)
                if not len(row):
                    continue
                first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(at) != 0)]))
                who = pa.array(row[first])
                home = batch.column(3).to_numpy()[row[first]]
                home = pa.array(np.where(blocks[home] == 1, home, -1), pa.int32())
                cells = pa.ListArray.from_arrays(
                    pa.array(np.append(first, len(row)), pa.int32()), pa.array(cell, pa.int32())
                )
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(who) for i in range(3)), pa.array(at[first], pa.int32()), cells, home],
                    names=["vid", "vec", "limit", "bundle", "cells", "own"],
                )

    return run


def _bundle_kernel(k: int, metric: str):
    """The k nearest points in the cells that each row visits, none beyond its limit."""
    nearest = _nearest_function(k, metric)

    def kernel(queries, points):
        if not len(queries) or not len(points):
            return pd.DataFrame({
                "vid": np.array([], dtype=np.int64), "nbr": np.array([], dtype=np.int64),
                "dist": np.array([], dtype=np.float64),
            })
        points = points.sort_values("cell", kind="stable")
        q_ids, p_ids, home = queries["vid"].to_numpy(), points["point"].to_numpy(), points["cell"].to_numpy()
        limit = queries["limit"].astype(float).fillna(np.inf).to_numpy()
        own = queries["own"].to_numpy()
        q, p = np.stack(queries["vec"].to_numpy()), np.stack(points["at"].to_numpy())
        who = np.repeat(np.arange(len(queries)), queries["cells"].map(len).to_numpy())
        cell = np.concatenate(queries["cells"].to_numpy())
        names, first = np.unique(home, return_index=True)
        ends = [*first[1:], len(home)]
        sizes = dict(zip(names.tolist(), np.diff([*first, len(home)]).tolist()))
        wanted = sum(sizes.get(c, 0) * int(n) for c, n in zip(*(a.tolist() for a in np.unique(cell, return_counts=True))))
        if wanted * 2 > len(q) * len(p):
            # One product over all is cheaper than one for each cell, and finds no less. What it
            # finds in a row's own block is known already and goes below.
            parts = [(np.arange(len(q)), slice(0, len(p)))]
        else:
            parts = [(who[cell == c], slice(a, b)) for c, a, b in zip(names, first, ends)]
        rows, cols, dists = [], [], []
        for mine, at in parts:
            if len(mine):
                r, c, d = nearest(q[mine], q_ids[mine], p[at], p_ids[at], limit[mine])
                other = own[mine[r]] != home[at][c]
                rows.append(mine[r[other]])
                cols.append(p_ids[at][c[other]])
                dists.append(d[other])
        r, c, d = (np.concatenate(x) if rows else np.zeros(0, np.int64) for x in (rows, cols, dists))
        order = np.lexsort((c, np.round(d, TIE_DIGITS), r))
        order = order[np.arange(len(r)) - np.searchsorted(r[order], r[order]) < k]
        return pd.DataFrame({"vid": q_ids[r[order]], "nbr": c[order], "dist": d[order]})

    return kernel


def _visit_kernel(k: int, metric: str):
    nearest = _nearest_function(k, metric)

    def kernel(queries, points):
        if not len(queries) or not len(points):
            return pd.DataFrame({
                "vid": np.array([], dtype=np.int64), "nbr": np.array([], dtype=np.int64),
                "dist": np.array([], dtype=np.float64),
            })
        q_ids, p_ids = queries["vid"].to_numpy(), points["point"].to_numpy()
        r, c, d = nearest(
            np.stack(queries["vec"].to_numpy()), q_ids, np.stack(points["at"].to_numpy()), p_ids
        )
        return pd.DataFrame({"vid": q_ids[r], "nbr": p_ids[c], "dist": d})

    return kernel
