import numpy as np
import pytest

from topicloom.operators import layout, plots


def graph_of(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, weight double")


def eigenvectors(edges, nodes):
    at = {n: i for i, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for x, y, w in edges:
        a[at[x], at[y]] = a[at[y], at[x]] = w
    degree = a.sum(1)
    values, vectors = np.linalg.eigh(a / np.sqrt(degree[:, None] * degree[None, :]))
    return values[::-1], vectors[:, ::-1] / np.sqrt(degree / degree.sum())[:, None]


def grid(first, rows, columns):
    """A grid with uneven weights, so that no two eigenvalues are equal."""
    at = lambda i, j: first + i * columns + j
    edges = [(at(i, j), at(i, j + 1), 1.0 + 0.1 * i) for i in range(rows) for j in range(columns - 1)]
    return edges + [(at(i, j), at(i + 1, j), 0.7 + 0.05 * j) for i in range(rows - 1) for j in range(columns)]


def coordinates(df):
    return {r["row_id"]: (r["x"], r["y"]) for r in df.collect()}


def test_layout_is_the_leading_eigenvectors(spark):
    edges = grid(10, 4, 9)
    nodes = sorted({n for e in edges for n in e[:2]})
    found = coordinates(layout.neighbor_layout(graph_of(spark, edges).repartition(5)))
    got = np.array([found[n] for n in nodes])
    _, vectors = eigenvectors(edges, nodes)
    want = vectors[:, 1:3] * np.sign((vectors[:, 1:3] * got).sum(0))
    assert np.abs(got - want).max() < 1e-3
    # The farthest row is on the positive side.
    assert all(got[np.abs(got[:, i]).argmax(), i] > 0 for i in range(2))


def test_parts_stand_side_by_side(spark):
    large, small, pair = grid(0, 4, 9), grid(100, 3, 4), [(200, 201, 0.3)]
    got = coordinates(layout.neighbor_layout(graph_of(spark, large + small + pair)))
    spans = []
    for edges in (large, small, pair):
        nodes = sorted({n for e in edges for n in e[:2]})
        own = np.array([got[n] for n in nodes])
        spans.append((own[:, 0].min(), own[:, 0].max()))
        _, vectors = eigenvectors(edges, nodes)
        scale = np.sqrt(len(nodes) / 36)
        want = vectors[:, 1] * scale
        own = own[:, 0] - own[:, 0].mean()
        want -= want.mean()
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-3
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert got[200][1] == got[201][1] == 0.0


def test_layout_that_does_not_settle_is_an_error(spark):
    with pytest.raises(layout.NotConverged):
        layout.neighbor_layout(graph_of(spark, grid(0, 12, 12)), rounds=2)
    assert layout.neighbor_layout(graph_of(spark, [])).count() == 0


def test_spread_keeps_rows_apart(spark):
    rows = [(i, 0.001 * i, 0.0) for i in range(30)] + [(100 + i, 10.0 * i, 5.0) for i in range(5)]
    edges = [(100 + i, 101 + i, 1.0) for i in range(4)]
    got = coordinates(layout.spread(
        spark.createDataFrame(rows, "row_id long, x double, y double"), graph_of(spark, edges), 0.1, ["x", "y"]
    ))
    near = np.array([got[i] for i in range(30)])
    gaps = np.sqrt(((near[:, None] - near[None]) ** 2).sum(2)) + np.eye(30)
    assert gaps.min() > 0.07
    # In units of the mean edge; rows alone in their cell stay.
    assert got[104] == (4.0, 0.5)


def vectors(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(3, 8)) * 3
    rows = [(i, [float(c) for c in centres[i % 3] + rng.normal(size=8)], i % 4 - 1, f"t{i % 4}", f"text {i}" * 30) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, embedding array<double>, topic_id int, topic_name string, review string")


def test_plots_follow_the_rules(spark):
    rows = vectors(spark, 60)
    three = plots.plot_table(rows, "review", 3).collect()
    assert {r["row_id"] for r in three} == {i for i in range(60) if i % 4}
    assert all(r["text"].endswith("...") for r in three) and len({(r["x"], r["y"], r["z"]) for r in three}) == 45
    refined = rows.filter("row_id < 30")
    two = plots.plot_table(rows, "review", 2, refined=refined).collect()
    assert {r["row_id"] for r in two} == {i for i in range(30) if i % 4}
    few = plots.plot_table(rows.filter("row_id < 3"), "review", 3).collect()
    assert len(few) == 2 and all(r["z"] == 0.0 for r in few)
    with pytest.raises(ValueError):
        plots.plot_table(rows, "review", 2, method="other")


def test_plots_fall_back_where_the_layout_does_not_settle(spark, monkeypatch):
    def unsettled(*_):
        raise layout.NotConverged

    rows = vectors(spark, 40)
    pca = {r["row_id"]: (r["x"], r["y"]) for r in plots.plot_table(rows, "review", 2, method="pca").collect()}
    monkeypatch.setattr(plots, "neighbor_layout", unsettled)
    got = {r["row_id"]: (r["x"], r["y"]) for r in plots.plot_table(rows, "review", 2).collect()}
    assert got.keys() == pca.keys() and all(np.allclose(got[i], pca[i]) for i in pca)
