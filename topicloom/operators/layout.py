"""Neighbour-preserving layout: fuzzy neighbour graph and its spectral coordinates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from topicloom.operators.spanning import spanning_tree
from topicloom.order import ranked, running
from topicloom.scratch import materialize
from topicloom.skew import hot_join, hot_keys, join_apart

BISECTIONS = 32
AXES = ["x", "y", "z"]
#: Room between parts of a layout, and turn between rows on a spiral.
PART_GAP, GOLDEN_ANGLE = 1.0, 2.399963229728653


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + term(v))


def _strength(d: Column, rho: Column, sigma: Column) -> Column:
    return F.when(d <= rho, 1.0).otherwise(F.exp(-(d - rho) / sigma))


def bandwidths(knn: DataFrame) -> DataFrame:
    """(row_id, rho, sigma): distance to the nearest distinct row and the local scale.

    sigma makes the strengths of a row's edges add up to log2 of their number.
    """
    lists = knn.groupBy("row_id").agg(F.array_sort(F.collect_list("dist")).alias("d"))
    near = lists.select(
        "row_id", "d", F.log2(F.size("d").cast("double")).alias("goal"),
        F.coalesce(F.array_min(F.filter("d", lambda x: x > 0)), F.lit(0.0)).alias("rho"),
    )
    rho, d, goal = F.col("rho"), F.col("d"), F.col("goal")

    def bisect(s: Column, _step: Column) -> Column:
        too_much = _sum(d, lambda x: _strength(x, rho, s["mid"])) > goal
        low = F.when(too_much, s["low"]).otherwise(s["mid"])
        high = F.when(too_much, s["mid"]).otherwise(s["high"])
        mid = F.when(high.isNull(), s["mid"] * 2).otherwise((low + high) / 2)
        return F.struct(low.alias("low"), high.alias("high"), mid.alias("mid"))

    start = F.struct(
        F.lit(0.0).alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("mid")
    )
    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, bisect)
    mean = _sum(d, lambda x: x) / F.size("d")
    return near.withColumn("found", found).select(
        "row_id", "rho", F.greatest(F.col("found.mid"), mean * 1e-3, F.lit(1e-12)).alias("sigma")
    )


def fuzzy_graph(knn: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: the union of both directions' strengths, s + t - s t."""
    directed = knn.join(bandwidths(knn), "row_id").select(
        F.least("row_id", "nbr_id").alias("a"), F.greatest("row_id", "nbr_id").alias("b"),
        _strength(F.col("dist"), F.col("rho"), F.col("sigma")).alias("s"),
    )
    both = F.max("s") + F.min("s") - F.max("s") * F.min("s")
    return directed.groupBy("a", "b").agg(
        F.when(F.count("*") == 2, both).otherwise(F.max("s")).alias("weight")
    )


def start_value(row_id: Column, axis: int) -> Column:
    """A fixed scatter in [-0.5, 0.5) that any engine can compute."""
    return F.pmod(F.pmod(row_id, 100_003) * (7_919 + 2 * axis) + 104_729, 10_007) / 10_007.0 - 0.5


class NotConverged(RuntimeError):
    """The eigenvectors of a layout did not settle within the bound on rounds."""


def neighbor_layout(
    graph: DataFrame, components: int = 2, tolerance: float = 1e-5, rounds: int = 200
) -> DataFrame:
    """(row_id, x, y[, z]): leading non-trivial eigenvectors of the normalised graph.

    Each part of the graph has coordinates of its own, against its own trivial eigenvector; the
    parts then stand side by side, the largest first. A block of vectors is improved together
    with its residuals and last steps (Rayleigh-Ritz in their span, solved part by part) until
    the residuals of the wanted vectors are below ``tolerance``; ``NotConverged`` is raised where
    ``rounds`` do not suffice. Each round is one product with the graph, a join and a sum; the
    driver only sees the largest residual.
    """
    width = components + 4
    edges = graph.select("a", "b", "weight").union(graph.select("b", "a", "weight"))
    edges = materialize(edges.toDF("row_id", "nbr_id", "weight"), "both-directions")
    degrees = materialize(edges.groupBy("row_id").agg(F.sum("weight").alias("degree")), "degrees")
    one = F.lit(1.0).alias("dist")
    _, parts = spanning_tree(degrees.select(F.col("row_id").alias("node")), graph.select("a", "b", one))
    placed = materialize(degrees.join(parts.toDF("row_id", "part"), "row_id"), "degrees")
    volumes = placed.groupBy("part").agg(F.sum("degree").alias("volume"))
    nodes = hot_join(placed, materialize(volumes, "volumes"), ["part"]).select(
        "row_id", "part", "degree", F.sqrt(F.col("degree") / F.col("volume")).alias("v0")
    )
    nodes = materialize(nodes, "layout-nodes")

    far = nodes.select(F.col("row_id").alias("nbr_id"), F.col("degree").alias("far_degree"))
    # Many rows may share one neighbour. Both directions are present, so either end serves.
    hubs = hot_keys(edges, ["nbr_id"])
    joined = join_apart(join_apart(edges, nodes.select("row_id", "degree"), ["row_id"], hubs), far, ["nbr_id"], hubs)
    weight = F.col("weight") / F.sqrt(F.col("degree") * F.col("far_degree"))
    links = materialize(joined.select("row_id", "nbr_id", weight.alias("weight")), "links")

    def times(state: DataFrame, name: str) -> DataFrame:
        """``state`` with the product of the graph and its column ``name``."""
        seen = state.select(F.col("row_id").alias("nbr_id"), *[F.col(name)[i].alias(f"s{i}") for i in range(width)])
        sums = join_apart(links, seen, ["nbr_id"], hubs).groupBy("row_id").agg(
            *[F.sum(F.col("weight") * F.col(f"s{i}")).alias(f"s{i}") for i in range(width)]
        )
        product = F.array(*[F.col(f"s{i}") for i in range(width)]).alias(f"a{name}")
        return state.join(sums, "row_id").select(*state.columns, product)

    zero = F.array_repeat(F.lit(0.0), width)
    state = nodes.select(
        "row_id", "part", "v0", zero.alias("x"), zero.alias("ax"),
        F.array(*[start_value(F.col("row_id"), i) for i in range(width)]).alias("r"),
        zero.alias("p"), zero.alias("ap"),
    )
    state = materialize(state, "layout")
    for step in range(rounds + 1):
        state = materialize(times(state, "r"), "layout-product")
        turns = materialize(
            state.select("part", "v0", *BLOCKS).mapInArrow(_grams(width), GRAMS)
            .groupBy("part").applyInPandas(_solve(width, components), TURNS),
            "layout-turns",
        )
        if step > 1 and (turns.agg(F.max("residual")).first()[0] or 0.0) <= tolerance:
            break
        if step == rounds:
            raise NotConverged(f"residuals above {tolerance} after {rounds} rounds")
        turned = hot_join(state, turns, ["part"]).select("row_id", "part", "v0", *BLOCKS, "turn", "shift", "values")
        # Read twice by the next product, which costs less than writing it.
        state = turned.mapInArrow(_turned(width), STATE)
    found = state.select("row_id", "part", *[(F.col("x")[i] / F.col("v0")).alias(AXES[i]) for i in range(components)])
    return _packed(materialize(found, "layout-found"), AXES[:components])


BLOCKS = ["x", "r", "p", "ax", "ar", "ap"]
STATE = "row_id long, part long, v0 double, x array<double>, ax array<double>, r array<double>, p array<double>, ap array<double>"
GRAMS = "part long, gram array<double>"
TURNS = "part long, turn array<double>, shift array<double>, values array<double>, residual double"
#: Parts whose sums a task holds at a time, and rows that it multiplies at a time.
HELD_PARTS, GRAM_ROWS = 2_000, 4_096


def _block(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _grams(width: int):
    """Per task and part: products of the block [x r p] with itself and with its image, and
    with the trivial vector."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, GRAM_ROWS):
                batch = whole.slice(start, GRAM_ROWS)
                part, v0 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                order = np.argsort(part, kind="stable")
                keys, first = np.unique(part[order], return_index=True)
                s, image = [
                    np.hstack([_block(batch.column(2 + i), width) for i in at])[order] for at in ((0, 1, 2), (3, 4, 5))
                ]
                for key, a, b in zip(keys.tolist(), first, [*first[1:], len(part)]):
                    left = s[a:b]
                    sums = np.concatenate([
                        (left.T @ left).ravel(), (left.T @ image[a:b]).ravel(), left.T @ v0[order[a:b]]
                    ])
                    held[key] = held[key] + sums if key in held else sums
                if len(held) > HELD_PARTS:
                    yield _gram_batch(held)
                    held = {}
        if held:
            yield _gram_batch(held)

    return run


def _gram_batch(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    values = np.stack(list(held.values()))
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))],
        names=["part", "gram"],
    )


def _solve(width: int, components: int):
    """Best vectors of a part in the span of its block, as a turn of the block."""
    n = 3 * width

    def run(key, pdf):
        sums = np.sum(np.stack(pdf["gram"].to_numpy()), axis=0)
        gram, image, trivial = sums[: n * n].reshape(n, n), sums[n * n : 2 * n * n].reshape(n, n), sums[2 * n * n :]
        # The span without the trivial vector, whose eigenvalue is one.
        away = np.outer(trivial, trivial)
        gram, image = gram - away, (image + image.T) / 2 - away
        size = np.sqrt(np.maximum(np.diag(gram), 0.0))
        residual = float(size[width : width + components].max())
        unit = np.where(size > 1e-14, 1 / np.where(size > 1e-14, size, 1.0), 0.0)
        values, basis = np.linalg.eigh(gram * unit[:, None] * unit[None, :])
        kept = values > 1e-9 * max(values[-1], 1e-300)
        span = unit[:, None] * basis[:, kept] / np.sqrt(values[kept])
        ritz, turn = np.linalg.eigh(span.T @ image @ span)
        turn = (span @ turn[:, ::-1])[:, :width]
        ritz = ritz[::-1][:width]
        full, eigen = np.zeros((n, width)), np.zeros(width)
        full[:, : turn.shape[1]], eigen[: len(ritz)] = turn, ritz
        return pd.DataFrame({
            "part": [int(key[0])], "turn": [full.ravel()], "shift": [trivial @ full], "values": [eigen], "residual": [residual],
        })

    return run


def _turned(width: int):
    """The block after the turn: new vectors, their images, residuals and steps."""
    n = 3 * width

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, GRAM_ROWS):
                batch = whole.slice(start, GRAM_ROWS)
                part, v0 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                s, image = [
                    np.hstack([_block(batch.column(3 + i), width) for i in at]) for at in ((0, 1, 2), (3, 4, 5))
                ]
                turn = batch.column(9).flatten().to_numpy().reshape(-1, n, width)
                shift, values = _block(batch.column(10), width), _block(batch.column(11), width)
                out = {k: np.empty((len(part), width)) for k in ("x", "ax", "p", "ap")}
                order = np.argsort(part, kind="stable")
                _, first = np.unique(part[order], return_index=True)
                for a, b in zip(first, [*first[1:], len(part)]):
                    at = order[a:b]
                    t = turn[at[0]]
                    step = t.copy()
                    step[:width] = 0.0
                    trivial = v0[at, None] * shift[at[0]]
                    out["x"][at], out["ax"][at] = s[at] @ t - trivial, image[at] @ t - trivial
                    out["p"][at], out["ap"][at] = s[at] @ step, image[at] @ step
                out["r"] = out["ax"] - out["x"] * values
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2),
                     *[pa.ListArray.from_arrays(ends, pa.array(out[k].ravel())) for k in ("x", "ax", "r", "p", "ap")]],
                    names=["row_id", "part", "v0", "x", "ax", "r", "p", "ap"],
                )

    return run


def _packed(found: DataFrame, axes: list[str]) -> DataFrame:
    """Parts side by side: signs by the farthest row, sizes by the number of rows."""
    far = lambda a: F.max_by(F.signum(a), F.struct(F.round(F.abs(F.col(a)), 9), -F.col("row_id")))
    parts = materialize(
        found.groupBy("part").agg(
            F.count("*").alias("n"), F.min("row_id").alias("head"), F.min("x").alias("low"), F.max("x").alias("high"),
            *[F.when(far(a) < 0, -1.0).otherwise(1.0).alias(f"sign_{a}") for a in axes],
        ),
        "layout-parts",
    )
    largest = parts.agg(F.max("n")).first()[0]
    if largest is None:
        return found.select("row_id", *axes)
    scale = F.sqrt(F.col("n") / largest)
    sized = materialize(
        parts.select(
            "part", "n", "head", scale.alias("scale"), *[f"sign_{a}" for a in axes],
            (F.when(F.col("sign_x") < 0, -F.col("high")).otherwise(F.col("low")) * scale).alias("low"),
            ((F.col("high") - F.col("low")) * scale).alias("width"),
        ),
        "layout-parts",
    )
    order = [F.desc("n"), F.col("head")]
    placed = running(sized, order, F.col("width") + F.lit(PART_GAP), "begin")
    # The first part stays where it is.
    first = sized.orderBy(*order).select("low").first()[0]
    places = materialize(placed.withColumn("move", F.col("begin") + first - F.col("low")), "layout-parts")
    moved = [F.col(a) * F.col(f"sign_{a}") * F.col("scale") for a in axes]
    moved[0] = moved[0] + F.col("move")
    return hot_join(found, places.drop("n"), ["part"]).select("row_id", *[m.alias(a) for m, a in zip(moved, axes)])


def spread(placed: DataFrame, graph: DataFrame, min_dist: float, axes: list[str]) -> DataFrame:
    """Coordinates in units of the mean length of the graph's edges, no rows on top of another.

    Rows that share a cell of side ``min_dist`` go on a spiral around the cell's centre, in the
    plane of the first two axes, where each keeps about ``min_dist`` from the others.
    """
    placed = materialize(placed, "spread-rows")
    a = placed.select(F.col("row_id").alias("a"), F.array(*axes).alias("pa"))
    b = placed.select(F.col("row_id").alias("b"), F.array(*axes).alias("pb"))
    gaps = F.transform(F.arrays_zip("pa", "pb"), lambda p: F.pow(p["pa"] - p["pb"], F.lit(2)))
    ends = join_apart(join_apart(graph, a, ["a"], hot_keys(graph, ["a"])), b, ["b"], hot_keys(graph, ["b"]))
    mean = ends.agg(F.avg(F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x)))).first()[0]
    unit = 1.0 / mean if mean else 1.0
    cells = [F.floor(F.col(c) / min_dist).alias(f"cell_{c}") for c in axes]
    keys = [f"cell_{c}" for c in axes]
    scaled = placed.select("row_id", *[(F.col(c) * unit).alias(c) for c in axes])
    scaled = materialize(scaled.select("*", *cells), "spread-rows")
    ordered = materialize(ranked(scaled, [*[F.col(k) for k in keys], F.col("row_id")], "place"), "spread-places")
    shared = materialize(
        ordered.groupBy(*keys).agg(F.min("place").alias("start"), F.count("*").alias("n")).filter("n > 1"), "shared-cells"
    )
    near = hot_join(ordered, shared, keys, how="left")
    i = F.col("place") - F.col("start")
    turn = [F.cos(i * GOLDEN_ANGLE), F.sin(i * GOLDEN_ANGLE)] + [F.lit(0.0)] * (len(axes) - 2)
    centre = [(F.col(k) + 0.5) * min_dist for k in keys]
    out = [
        F.when(F.col("n").isNull(), F.col(c)).otherwise(m + min_dist * F.sqrt(i) * t).alias(c)
        for c, m, t in zip(axes, centre, turn)
    ]
    return near.select("row_id", *out)
