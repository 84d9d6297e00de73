import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from topicloom.operators import descent, neighbors
from topicloom.operators.neighbors import SearchSize, collapse_copies, knn_graph
from topicloom.functions.vectors import unit


def brute_force(ids, x, k, metric):
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    out = set()
    for i in range(len(ids)):
        others = sorted((round(d[i, j], 9) + 0.0, ids[j]) for j in range(len(ids)) if j != i)
        for rank, (_, nbr) in enumerate(others[:k], 1):
            out.add((ids[i], nbr, rank))
    return out


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 4
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.4
    return np.round(x, 3)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_many_cells_and_blocks_match_brute_force(spark, metric):
    x = clustered(240, 5, 1)
    x[:80] = x[0]  # one group of copies holds a third of all rows
    ids = [int(i) for i in np.random.default_rng(2).permutation(1000)[:240]]
    df = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in zip(ids, x)],
        "row_id long, embedding array<double>",
    ).repartition(5)
    size = SearchSize(cell_rows=20, block_rows=7)
    got = {
        (r["row_id"], r["nbr_id"], r["rank"])
        for r in knn_graph(df, k=4, metric=metric, size=size).collect()
    }
    assert got == brute_force(ids, x, 4, metric)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_bundles_of_cells_match_brute_force_and_move_a_row_once(spark, metric):
    x = clustered(200, 4, 5)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, embedding array<double>")
    size = SearchSize(cell_rows=5, block_rows=9, bundle_rows=40)
    found = knn_graph(df, k=4, metric=metric, size=size)
    assert {(r["row_id"], r["nbr_id"], r["rank"]) for r in found.collect()} == brute_force(list(range(200)), x, 4, metric)
    # Forty cells in bundles of forty rows: a row has at most one visit to each.
    count = np.full(40, 5)
    bundle = neighbors._bundles(np.sort(np.random.default_rng(1).normal(size=(40, 2))), count, np.ones(40, np.int64), 40)
    assert len(np.unique(bundle)) <= 8 and all(count[bundle == b].sum() <= 40 for b in bundle)
    batch = pa.RecordBatch.from_pydict({
        "vid": [1], "vec": [[0.0, 0.0]], "limit": [None], "cell": pa.array([0], pa.int32()), "block": [0],
        "targets": pa.array([list(range(40))], pa.list_(pa.int32())),
    })
    visits = list(neighbors._visits(bundle, np.ones(40, np.int64))([batch]))[0].to_pydict()
    assert len(visits["bundle"]) == len(np.unique(bundle)) and sorted(sum(visits["cells"], [])) == list(range(1, 40))


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "row_id long, embedding array<double>"
    )
    rows = {(r["row_id"], r["nbr_id"], r["rank"]) for r in knn_graph(df, k=5).collect()}
    assert rows == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)}


def test_near_copies_give_the_same_lists_for_any_cell_size(spark):
    """Distances that tie after rounding go by id, also where cells are ruled out."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=16)
    rows = []
    for i in range(200):
        v = base + rng.normal(size=16) * 2e-6
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)]))
    vectors = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    found = []
    for size in (SearchSize(20, 7), SearchSize()):
        graph = knn_graph(vectors, 4, size=size)
        found.append(sorted((r[0], r[1]) for r in graph.select(*graph.columns[:2]).collect()))
    assert found[0] == found[1]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_descent_finds_nearly_all_neighbours(spark, metric):
    x = np.random.default_rng(3).normal(size=(1200, 16))
    df = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, vec array<double>"
    )
    rows = df.withColumn("vec", unit("vec")) if metric == "cosine" else df
    _, distinct = collapse_copies(rows)
    found = descent.descent_neighbors(distinct, 8, metric)
    got = {(r["vid"], r["nbr"]) for r in found.collect()}
    want = {(a, b) for a, b, _ in brute_force(list(range(len(x))), x, 8, metric)}
    assert len(got) == 8 * len(x)
    assert len(got & want) / len(want) >= 0.9
    asked = {p for p in want if p[0] % 10 == 0}
    measured = descent.recall(distinct, found, 8, metric, every=10, block_rows=100)
    assert measured == pytest.approx(len(got & asked) / len(asked))


def test_descent_with_copies_few_rows_and_too_few_rounds(spark):
    x = clustered(60, 3, 5)
    x[:20] = x[0]
    df = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, embedding array<double>"
    )
    got = knn_graph(df, 4, "euclidean", search=descent.descent_neighbors)
    # Lists as long as the table hold every row, so nothing is missed.
    every = lambda d, k, m: descent.descent_neighbors(d, k, m, pool=60)
    exact = knn_graph(df, 4, "euclidean", search=every)
    assert {(r[0], r[1], r[2]) for r in exact.collect()} == brute_force(list(range(60)), x, 4, "euclidean")
    assert got.count() == exact.count()
    assert knn_graph(df.filter("row_id < 1"), 4, search=descent.descent_neighbors).count() == 0
    _, distinct = collapse_copies(df.withColumnRenamed("embedding", "vec"))
    with pytest.raises(descent.NotSettled):
        descent.descent_neighbors(distinct, 4, "euclidean", rounds=0)


def test_descent_sends_a_vector_once_to_a_part(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(1200, 16))
    df = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, vec array<double>"
    )
    rounds, write = [], descent.materialize

    def written(table, name):
        table = write(table, name)
        if name == "descent-hubs":
            rounds.append(table)
        return table

    monkeypatch.setattr(descent, "materialize", written)
    # Several planes, and groups of which some are split by hash.
    monkeypatch.setattr(descent, "START_ROWS", 40)
    monkeypatch.setattr(descent, "LEAST_PARTS", 3)
    found = descent.descent_neighbors(collapse_copies(df)[1], 8, "euclidean")
    sent = [
        (t.selectExpr("part", "explode(members) AS vid").distinct().count(), t.selectExpr("sum(size(members))").first()[0])
        for t in rounds[:1]
    ]
    assert sent and all(rows <= 3 * len(x) and rows * 10 < members for rows, members in sent)
    want = {(a, b) for a, b, _ in brute_force(list(range(len(x))), x, 8, "euclidean")}
    got = {(r["vid"], r["nbr"]): r["dist"] for r in found.collect()}
    assert len(want & set(got)) / len(want) >= 0.9
    assert all(d == pytest.approx(np.linalg.norm(x[a] - x[b]), abs=1e-12) for (a, b), d in got.items())


def test_descent_compares_new_pairs_only():
    x = np.random.default_rng(5).normal(size=(5, 3)).astype(np.float32)
    hubs = pa.table({"members": [[10, 11, 12], [11, 12, 13, 14]], "fresh": [[False, True, False], [False, True, False, False]]})
    rows = pa.table({
        "vid": [12, 11, 10, 14, 13], "vec": x[[2, 1, 0, 4, 3]].tolist(), "tag": pa.array([2, 1, 0, 4, 3], pa.int32()),
        "bound": [float("inf")] * 5, "known": pa.array([[1], [2], [], [], []], pa.list_(pa.int32())),
    })
    got = descent._compare("euclidean", 2)(hubs, rows).to_pandas()
    pairs = {(10, 11), (11, 10), (12, 13), (12, 14), (13, 12), (14, 12)}
    assert sorted(zip(got["vid"], got["nbr"])) == sorted(pairs)
    for a, b, d in got.itertuples(index=False):
        assert d == pytest.approx(np.linalg.norm(x[a - 10].astype(float) - x[b - 10]))


@pytest.mark.parametrize("limits", ["none", "some", "all"])
@pytest.mark.parametrize("kind", ["plain", "ties", "far", "single", "nan"])
def test_block_search_computes_few_distances_and_finds_the_same(monkeypatch, kind, limits):
    rng = np.random.default_rng(7)
    q, p = rng.normal(size=(300, 5)), rng.normal(size=(900, 5))
    if kind == "ties":
        q, p = np.round(q), np.round(p)
    if kind == "far":  # the products lose most digits
        q, p = q * 1e-6 + 1e5, p * 1e-6 + 1e5
    if kind == "single":
        q, p = q.astype(np.float32), p.astype(np.float32)
    if kind == "nan":
        q[3, 1] = p[5, 2] = np.nan
    q_ids, p_ids = np.arange(300) * 3, rng.permutation(900)
    p_ids[7] = p_ids[8]
    p[p_ids < 300] = q[p_ids[p_ids < 300] // 3]
    d = np.zeros((300, 900))
    for i in range(5):
        d += (q[:, i][:, None] - p[:, i][None, :]) ** 2
    d = np.sqrt(d)
    key = np.where(q_ids[:, None] == p_ids[None, :], np.inf, np.round(d, 9))
    key = np.where(np.isnan(key), np.inf, key)
    most = np.full(300, np.inf)
    if limits != "none":
        most[:: 1 if limits == "all" else 2] = np.sort(key, axis=1)[:: 1 if limits == "all" else 2, 9]
    want = []
    for i in range(300):
        near = [j for j in np.lexsort((p_ids, key[i])) if np.isfinite(key[i, j]) and key[i, j] <= most[i]][:7]
        want += [(i, j, d[i, j]) for j in near]
    nearest = neighbors._nearest_function(7, "euclidean")
    for step in (neighbors.STEP_VALUES, 5_000):
        monkeypatch.setattr(neighbors, "STEP_VALUES", step)
        found = zip(*nearest(q, q_ids, p, p_ids, None if limits == "none" else most))
        assert sorted(found, key=lambda e: e[0]) == want
    if kind in ("plain", "ties"):
        seen, sqrt = [], np.sqrt
        monkeypatch.setattr(neighbors.np, "sqrt", lambda v: (seen.append(np.size(v)), sqrt(v))[1])
        nearest(q, q_ids, p, p_ids, None if limits == "none" else most)
        assert sum(seen) < 0.3 * d.size


def test_block_rules_out_far_pivots_without_looking(monkeypatch):
    rng = np.random.default_rng(9)
    pivots = np.array([[100.0 * i, 0.0] for i in range(400)])
    rows = rng.normal(size=(60, 2))
    rows[1] = [150.0, 0.0]  # between two pivots, and far from all rows
    frame = pd.DataFrame({"vid": np.arange(60), "vec": list(rows), "cell": 0, "block": 0})
    count, radius = np.full(400, 60), np.full(400, 3.0)
    counted, sqrt = [], np.sqrt
    monkeypatch.setattr(neighbors, "STEP_VALUES", 4_000)
    kernel = neighbors._own_block_kernel(pivots, count, radius, np.ones(400, np.int64), 5, "euclidean")
    monkeypatch.setattr(neighbors.np, "sqrt", lambda v: (counted.append(np.size(v)), sqrt(v))[1])
    found = kernel((0,), frame)
    d = sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
    reach = np.sort(d, axis=1)[:, 5]
    for i, targets in enumerate(found["targets"]):
        to = sqrt(((pivots - rows[i]) ** 2).sum(1))
        lower = np.maximum(to - radius, np.r_[0, (to[1:] ** 2 - to[0] ** 2) / (2 * pivots[1:, 0])])
        near = np.minimum(reach[i], (to + radius).min())
        assert set(targets) == {c for c in range(1, 400) if lower[c] <= near + 1e-6 * (1 + to[c])}
    assert sum(counted) < 60 * 400 / 2
