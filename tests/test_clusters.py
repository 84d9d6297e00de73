import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom import skew
from topicloom.operators import clusters, condense, density, weights
from topicloom.operators.components import connected_components
from topicloom.operators.spanning import spanning_tree
from topicloom.plans.topic_model import TopicParams, fit
from topicloom.scratch import materialize


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = {}
    for n in nodes:
        groups.setdefault(root(n), set()).add(n)
    return {frozenset(g) for g in groups.values()}


def test_components_of_several_graphs(spark):
    rng = np.random.default_rng(3)
    graphs = {
        0: (range(60), [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))]),
        1: (range(40), [(i, i + 1) for i in range(39)]),  # a chain
        2: (range(30), [(0, i) for i in range(1, 20)]),  # a star and single nodes
    }
    nodes = spark.createDataFrame(
        [(g, n) for g, (ns, _) in graphs.items() for n in ns], "level int, node long")
    edges = spark.createDataFrame(
        [(g, a, b) for g, (_, es) in graphs.items() for a, b in es], "level int, a long, b long")
    found = {}
    for r in connected_components(nodes, edges, "level").collect():
        found.setdefault((r["level"], r["component"]), set()).add(r["node"])
    for g, (ns, es) in graphs.items():
        got = {frozenset(v) for (level, _), v in found.items() if level == g}
        assert got == union_find(ns, es)


def test_hot_join_equals_plain_join(spark):
    rows = spark.range(300).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        plain = sorted(map(str, rows.join(dim, "k", how).collect()))
        hot = skew.hot_join(rows, dim, ["k"], how, min_hot_rows=10)
        assert sorted(map(str, hot.collect())) == plain


def blobs(spark, copies=0):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0]])
    points, truth = [], []
    for i, c in enumerate(centres):
        for p in rng.normal(size=(40, 3)) * 0.5 + c:
            points.append(p)
            truth.append(i)
    # Fewer than a cluster needs: at some distance any ten of them would be one.
    for p in rng.uniform(-60, 60, size=(9, 3)) + 100:
        points.append(p)
        truth.append(-1)
    for _ in range(copies):
        points.append(points[0])
        truth.append(0)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "row_id long, vec array<double>"), truth


def parts_within(nodes, edges, most):
    """Components of the graph's edges of at most this length."""
    return union_find(nodes, [(a, b) for a, b, d in edges if d <= most])


def clusters_by_definition(weights, edges, min_size):
    """Excess-of-mass clusters from the components at every distance, top down."""
    distances = sorted({d for _, _, d in edges})
    if not distances:
        return set()
    weight = lambda part: sum(weights[v] for v in part)
    gain = lambda d: 1 / max(d, 1e-12)

    def below(part, i):
        """Sizeable components of a part once edges of distance i and more are gone."""
        inside = [(a, b, d) for a, b, d in edges if a in part and b in part]
        smaller = distances[i - 1] if i else -1.0
        return [p for p in parts_within(part, inside, smaller) if weight(p) >= min_size]

    def solve(part, i, born):
        """Best stability and clusters of a part that is whole at distance i."""
        total, at = 0.0, part
        while True:
            kids = below(at, i) if i >= 0 else []
            inside = [(a, b, d) for a, b, d in edges if a in at and b in at and d <= distances[i]]
            if len(kids) == 1 and kids[0] == at:
                i -= 1
                if i < 0 or not inside:
                    # A vector with many copies: its rows count from its first edge on.
                    return None
                continue
            gone = gain(distances[i]) - gain(born) if inside else 0.0
            if len(kids) == 1:
                lost = weight(at) - weight(kids[0])
                total += lost * gone
                at, i = kids[0], i - 1
                if len(at) == 1:
                    total += weight(at) * gone
                    return total, {part}
                continue
            total += weight(at) * gone
            if not kids:
                return total, {part}
            found = [solve(k, i - 1, distances[i]) if len(k) > 1 else (0.0, {k}) for k in kids]
            best = sum(f[0] for f in found)
            if total >= best:
                return total, {part}
            return best, set().union(*[f[1] for f in found])

    nodes = frozenset(weights)
    top = len(distances) - 1
    whole = [p for p in parts_within(nodes, edges, distances[top]) if weight(p) >= min_size]
    while len(whole) == 1 and top >= 0:  # all of the data are no cluster
        smaller = distances[top - 1] if top else -1.0
        inside = [(a, b, d) for a, b, d in edges if a in whole[0] and b in whole[0]]
        whole, born = [p for p in parts_within(whole[0], inside, smaller) if weight(p) >= min_size], distances[top]
        top -= 1
    else:
        born = distances[-1] if len(whole) != 1 and top == len(distances) - 1 else born
    if len(whole) < 2:
        return set()
    return set().union(*[solve(p, max(top, 0), born)[1] if len(p) > 1 else {p} for p in whole])


def clustered_points(kind):
    rng = np.random.default_rng({"plain": 1, "ties": 2, "copies": 3, "apart": 4}[kind])
    if kind == "ties":
        return [(float(x), float(y)) for x, y in rng.integers(0, 9, (70, 2))]
    centres = rng.normal(size=(4, 2)) * 6
    points = [tuple(map(float, centres[i % 4] + rng.normal(size=2) * (0.3 + i % 4))) for i in range(70)]
    if kind == "copies":
        points += [points[0]] * 30 + [points[5]] * 9 + [points[9]] * 30
    if kind == "apart":
        points = [(x + 1000 * (i % 3), y) for i, (x, y) in enumerate(points)]
    return points


@pytest.mark.parametrize("kind,k,chunk", [
    ("plain", 80, 500), ("ties", 80, 5), ("copies", 6, 9), ("apart", 6, 500),
])
def test_density_clusters_equal_the_definition(spark, kind, k, chunk):
    points = clustered_points(kind)
    copies = {}
    for i, p in enumerate(points):
        copies.setdefault(p, []).append(i)
    distinct = sorted(copies, key=lambda p: copies[p][0])
    vid = {p: copies[p][0] for p in distinct}
    x = np.array(distinct)
    d = np.zeros((len(x), len(x)))
    for c in range(x.shape[1]):
        d += (x[:, c][:, None] - x[:, c][None, :]) ** 2
    d = np.sqrt(d)
    ids = np.array([vid[p] for p in distinct])
    core, near = {}, {}
    for i, p in enumerate(distinct):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (round(d[i, j], 9), ids[j]))[:max(k, 5)]
        near[i], seen, far = order, len(copies[p]), 0.0
        for j in sorted(order, key=lambda j: (d[i, j], ids[j])):
            if seen >= 6:
                break
            seen, far = seen + len(copies[distinct[j]]), d[i, j]
        core[i] = far
    edges = {}
    for i, others in near.items():
        for j in others:
            edges[tuple(sorted((int(ids[i]), int(ids[j]))))] = float(max(core[i], core[j], d[i, j]))
    weights = {vid[p]: len(copies[p]) for p in distinct}
    parts = list(parts_within(set(weights), [(a, b, e) for (a, b), e in edges.items()], np.inf))
    for p, q in itertools.combinations(parts, 2):  # bridged where the parts are nearest
        cross = [(max(core[i], core[j], d[i, j]), *sorted((int(ids[i]), int(ids[j])))) for i in range(len(x)) for j in range(len(x))
                 if ids[i] in p and ids[j] in q]
        e, a, b = min(cross)
        edges[a, b] = float(e)
    want = {
        frozenset(r for v in part for r in copies[points[v]])
        for part in clusters_by_definition(weights, [(a, b, e) for (a, b), e in edges.items()], 6)
    }
    df = spark.createDataFrame([(i, list(p)) for i, p in enumerate(points)], "row_id long, vec array<double>")
    results = []
    for parts in (2, 7) if kind == "plain" else (3,):
        rows = density.density_clusters(df.repartition(parts), "vec", 6, k=k, chunk_edges=chunk).collect()
        results.append({r["row_id"]: r["topic_id"] for r in rows})
    assert results[0] == results[-1] and len(results[0]) == len(points)
    got = {}
    for row, topic in results[0].items():
        if topic != -1:
            got.setdefault(topic, set()).add(row)
    assert set(map(frozenset, got.values())) == want and want


@pytest.mark.parametrize("collect_edges", [0, 100, 1000])
def test_spanning_tree_is_the_lightest(spark, collect_edges):
    rng = np.random.default_rng(8)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 120, (400, 2)) if a != b})
    edges = [(a, b, float(rng.integers(1, 12))) for a, b in edges]
    nodes = [(i,) for i in range(125)]
    parent = list(range(125))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    want = set()
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add((a, b, w))
    tree, parts = spanning_tree(
        spark.createDataFrame(nodes, "node long"), spark.createDataFrame(edges, "a long, b long, dist double").repartition(5),
        collect_edges,
    )
    got = tree.collect()
    sets = {}
    for r in parts.collect():
        sets.setdefault(r["part"], set()).add(r["node"])
    assert set(map(frozenset, sets.values())) == union_find(range(125), [e[:2] for e in edges])
    assert {tuple(r) for r in got if np.isfinite(r["dist"])} == want
    assert len(got) == 124


@pytest.mark.parametrize("copies", [0, 66])
def test_density_clusters_find_blobs_and_noise(spark, copies):
    df, truth = blobs(spark, copies)
    got = {r["row_id"]: r["topic_id"] for r in
           density.density_clusters(df, "vec", min_size=10).collect()}
    assert len(got) == len(truth)
    by_truth = {}
    for i, t in enumerate(truth):
        by_truth.setdefault(t, []).append(got[i])
    assert sum(t != -1 for t in by_truth[-1]) == 0
    main = {t: max(set(v), key=v.count) for t, v in by_truth.items() if t != -1}
    assert sorted(main.values()) == [0, 1, 2]
    for t, label in main.items():
        assert by_truth[t].count(label) >= 0.9 * len(by_truth[t])


def test_kmeans_does_not_depend_on_partitions(spark, monkeypatch):
    df, _ = blobs(spark)
    monkeypatch.setattr(clusters, "FIT_ROWS", 40)
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, shuffled in ((2, 4), (7, 8), (3, 23)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffled)
            rows = clusters.kmeans_topics(df.repartition(parts), "vec", 4, min_size=5).collect()
            results.append(sorted((r["row_id"], r["topic_id"]) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == df.count()


def merged_by_hand(rows, sizes, goal):
    """The smallest topic into its most similar one, one merge after the other."""
    vectors = {}
    for t, term, n, idf, _ in rows:
        if t != -1:
            vectors.setdefault(t, {})[term] = n * idf
    alive = {t: n for t, n in sizes if t != -1}
    for t in alive:
        vectors.setdefault(t, {})
    target = {t: t for t in alive}
    while len(alive) > goal:
        victim = min(alive, key=lambda t: (alive[t], -t))
        own = vectors.pop(victim)
        length = sum(v * v for v in own.values())

        def score(t):
            other = vectors[t]
            dot = sum(v * other[w] for w, v in own.items() if w in other)
            return round(dot / max((length * sum(v * v for v in other.values())) ** 0.5, 1e-300), 9)

        partner = max((t for t in alive if t != victim), key=lambda t: (score(t), -t))
        for w, v in own.items():
            vectors[partner][w] = vectors[partner].get(w, 0.0) + v
        alive[partner] += alive.pop(victim)
        target = {t: partner if now == victim else now for t, now in target.items()}
    return target | {-1: -1}


@pytest.mark.parametrize("topics,goal,cells", [(7, 2, 4_000_000), (7, 2, 8), (60, 5, 600), (2000, 400, 4_000_000)])
def test_topic_merges_equal_a_plain_loop(spark, topics, goal, cells):
    rng = np.random.default_rng(topics)
    rows = []
    for t in range(-1, topics):
        for j in rng.choice(max(12, topics // 4), 8, replace=False):
            rows.append((t, f"w{j}", int(rng.integers(1, 9)), 1.0 + int(j) % 10 / 10, 0.0))
    sizes = [(t, int(10 + rng.integers(0, 40))) for t in range(-1, topics)]
    weights = spark.createDataFrame(rows, "topic_id int, term string, n long, idf double, weight double")
    got = clusters.reduce_topics(
        weights, spark.createDataFrame(sizes, "topic_id int, n long"), goal + 1, cells=cells
    ).collect()
    assert dict(map(tuple, got)) == merged_by_hand(rows, sizes, goal)


def test_merges_hold_products_in_small_room(spark):
    import tracemalloc

    # All pairs share a term: 499,500 products, at about 400 bytes each as row objects and dicts.
    n = 1_000
    rows = spark.range(n).select(F.col("id").cast("int").alias("topic_id"), F.lit("w").alias("term"), (F.col("id") + 1).alias("n"), F.lit(1.0).alias("idf"))
    sizes = rows.select("topic_id", F.lit(10).cast("long").alias("n"))
    for cells in (n * n, n * n // 2):
        tracemalloc.start()
        try:
            got = dict(map(tuple, clusters.reduce_topics(rows, sizes, n - 2, cells=cells).collect()))
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        # Of equal sizes the last topic goes first, into the first of those that are all alike.
        assert got == {t: t if t < n - 2 else 0 for t in range(n)}
        assert peak < 60e6


def test_products_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (40, 30)) * rng.integers(0, 2, (40, 30))
    rows = [(t, f"w{j}", float(v)) for t, r in enumerate(x) for j, v in enumerate(r) if v]
    monkeypatch.setattr("topicloom.operators.weights.BLOCK_TOPICS", 6)
    from topicloom.operators.weights import topic_products

    vectors = spark.createDataFrame(rows, "topic_id int, term string, value double").repartition(5)
    g = x @ x.T
    got = {(r["a"], r["b"]): r["g"] for r in topic_products(vectors).collect()}
    assert got == {(i, j): float(g[i, j]) for i in range(40) for j in range(i, 40) if g[i, j]}
    wanted = spark.createDataFrame([(3,), (17,)], "topic_id int")
    some = {(r["a"], r["b"]): r["g"] for r in topic_products(vectors, wanted).collect()}
    assert some == {(i, j): float(g[i, j]) for i in (3, 17) for j in range(40) if j != i and g[i, j]}


def test_similarity_of_topics(spark):
    from topicloom.operators.weights import topic_similarity

    rows = [(0, "a", 3.0), (0, "b", 4.0), (1, "a", 1.0), (1, "c", 2.0), (2, "d", 5.0)]
    df = spark.createDataFrame(rows, "topic_id int, term string, weight double")
    got = {(r[0], r[1]): r[2] for r in topic_similarity(df).collect()}
    assert got.keys() == {(0, 1), (0, 2), (1, 2)}
    assert abs(got[0, 1] - 3 / (5 * 5 ** 0.5)) < 1e-12
    assert got[0, 2] == got[1, 2] == 0.0
    apart = topic_similarity(df.filter("term IN ('b', 'c', 'd')")).collect()
    assert len(apart) == 3 and all(r["similarity"] == 0.0 for r in apart)


@pytest.mark.parametrize("language", ["english", "any"])
def test_terms_of_merged_topics_add_up_within_their_rows(spark, language):
    texts = [
        (0, "red fox red fox runs"), (1, "red fox sleeps"), (2, "blue whale sings"), (0, "fox sings"), (-1, "red whale red"),
        (3, "blue whale sings"), (1, None), (2, ""), (4, "red fox"),
    ] * 3
    topics = spark.createDataFrame(texts, "topic_id int, text string").repartition(5)
    merges = {-1: -1, 0: 1, 1: 1, 2: 0, 3: 0, 4: 2}
    counts = weights.class_term_counts(topics, "text", language).toPandas()
    rows = lambda df: sorted(map(tuple, df.collect()))
    for documents in (0, 7_000):
        terms = materialize(weights.class_terms(topics, "text", language, documents=documents), "terms")
        assert terms.count() == counts["term"].nunique()
        corpus = counts.groupby("term")["n"].sum()
        held = rows(weights.held_counts(terms))
        assert held == sorted((t, w, n, corpus[w]) for t, w, n in counts.itertuples(index=False))
        new = spark.createDataFrame(list(merges.items()), "topic_id int, new_id int")
        merged = materialize(weights.merged_counts(terms, new), "merged")
        wanted = counts.assign(topic_id=counts["topic_id"].map(merges)).groupby(["topic_id", "term"], as_index=False)["n"].sum()
        assert rows(merged) == sorted((t, w, n, corpus[w]) for t, w, n in wanted.itertuples(index=False))
        totals = materialize(weights.topic_terms(merged), "totals")
        plain = weights.ctfidf(materialize(spark.createDataFrame(wanted), "counts"))
        assert rows(weights.weighted(merged, totals)) == rows(plain)


def test_fit_sorts_no_terms_again(spark, monkeypatch):
    def again(*_):
        raise AssertionError("term counts are sorted by term a second time")

    monkeypatch.setattr(weights, "ctfidf", again)
    rows = spark.createDataFrame(
        [(i, ["red fox runs", "blue whale sings", "old oak grows"][i % 3] + " on" * (i % 2)) for i in range(60)],
        "row_id long, review string",
    )
    model = fit(rows, "review", params=TopicParams(method="kmeans", first_clusters=4, n_topics=2, min_topic_size=2))
    assert model.topics.count() == 60 and set(model.weights.columns) == {"topic_id", "term", "n", "idf", "weight"}


@pytest.mark.parametrize("chunk", [40, 1000])
def test_driver_gives_moves_back_as_arrow_tables(spark, monkeypatch, chunk):
    seen, plain = [], condense._merge

    def merge(*args):
        seen.append(plain(*args))
        return seen[-1]

    monkeypatch.setattr(condense, "_merge", merge)
    rng = np.random.default_rng(4)
    edges = [(int(rng.integers(0, i)), i, float(rng.integers(1, 30))) for i in range(1, 90)]
    tree = materialize(spark.createDataFrame(edges, "a long, b long, dist double"), "tree")
    weights_ = spark.createDataFrame([(i, 1 + 4 * (i % 9 == 0)) for i in range(90)], "vid long, copies long")
    found = condense.condensed_labels(tree, weights_, 5, chunk).collect()
    assert sorted(r["vid"] for r in found) == list(range(90))
    assert seen and all(isinstance(t, pa.Table) for pair in seen for t in pair)


def test_core_distances_keep_lists_for_the_reachability(spark):
    near = materialize(spark.createDataFrame(
        [(1, 2, 0.5), (1, 3, 0.7), (2, 1, 0.5), (2, 3, 0.6), (3, 2, 0.6), (3, 1, 0.7)], "vid long, nbr long, dist double"
    ), "near")
    copies = spark.createDataFrame([(1, 1), (2, 3), (3, 1), (4, 1)], "vid long, copies long")
    core = materialize(density.core_distances(near, copies, 3), "core")
    assert {(r["vid"], r["copies"], r["core"]) for r in core.collect()} == {(1, 1, 0.5), (2, 3, 0.0), (3, 1, 0.6)}
    assert set(map(tuple, density.reachability(core).collect())) == {(1, 2, 0.5), (1, 3, 0.7), (2, 3, 0.6)}
