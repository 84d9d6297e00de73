"""Partition clustering, small-cluster outliers, topic reduction and renumbering."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from topicloom.constants import OUTLIER_ID
from topicloom.functions.vectors import cosine
from topicloom.operators.joins import lookup
from topicloom.operators.weights import topic_products
from topicloom.scratch import materialize

#: Rows of a partition of the k-means fit.
FIT_ROWS = 20_000
#: Products of topics that one round of merges brings to the driver.
MERGE_CELLS = 4_000_000


def kmeans_topics(
    df: DataFrame, vec_col: str, k: int, min_size: int, seed: int = 42,
    measure: str = "euclidean",
) -> DataFrame:
    """``df`` with topic_id: clusters by size, those below ``min_size`` as outliers.

    Rows are laid out by key first, ``FIT_ROWS`` to a partition, so the seeded fit depends
    neither on how the input was partitioned nor on the session's settings. Give it a written
    table: the vectors are read for the fit and the result.
    """
    parts = 1 + df.count() // FIT_ROWS
    data = (
        df.select("row_id", array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
        .repartition(parts, "row_id").sortWithinPartitions("row_id")
    )
    model = KMeans(
        k=k, seed=seed, distanceMeasure=measure, featuresCol="_v", predictionCol="topic_id"
    ).fit(data)
    assigned = model.transform(data).select("row_id", F.col("topic_id").cast("int"))
    assigned = materialize(assigned, "kmeans-topics")
    labelled = renumber_topics(small_to_outliers(assigned, min_size))
    return df.join(labelled, "row_id")


def small_to_outliers(topics: DataFrame, min_size: int) -> DataFrame:
    """Topics with fewer than ``min_size`` rows become outliers."""
    sizes = topics.groupBy("topic_id").agg(F.count("*").alias("_n"))
    return lookup(topics, sizes, "topic_id").withColumn(
        "topic_id", F.when(F.col("_n") < min_size, OUTLIER_ID).otherwise(F.col("topic_id"))
    ).drop("_n")


def size_ranks(topics: DataFrame) -> DataFrame:
    """(topic_id, new_id): 0 for the largest topic; outliers keep their id. One row per topic."""
    sizes = topics.groupBy("topic_id").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), "topic_id")
    ranked = sizes.filter(F.col("topic_id") != OUTLIER_ID).select(
        "topic_id", (F.row_number().over(order) - 1).cast("int").alias("new_id")
    )
    return ranked.union(
        sizes.filter(F.col("topic_id") == OUTLIER_ID)
        .select("topic_id", F.lit(OUTLIER_ID).alias("new_id"))
    )


def relabel(topics: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace topic_id by the mapping's new_id."""
    return lookup(topics, mapping, "topic_id", "inner").withColumn(
        "topic_id", F.col("new_id")
    ).drop("new_id")


def renumber_topics(topics: DataFrame) -> DataFrame:
    return relabel(topics, size_ranks(topics))


def topics_to_keep(n_topics: int, has_outliers: bool, count_outlier: bool = True) -> int:
    return max(1, n_topics - (1 if has_outliers and count_outlier else 0))


def reduce_topics(
    weights: DataFrame, sizes: DataFrame, n_topics: int, count_outlier: bool = True,
    cells: int = MERGE_CELLS,
) -> DataFrame:
    """(topic_id, new_id): merge the smallest topic into its most similar one until enough.

    ``weights`` is (topic_id, term, n, idf), ``sizes`` is (topic_id, n). Topics are compared
    by the cosine of n times idf, rounded to nine places, ties to the smaller id; n times idf
    adds up when topics merge, and idf stays that of the fit. Outliers never merge.

    Products of vectors add up too. So one round gets the products of the smallest topics with
    all others, at most ``cells`` numbers, and merges on them in order for as long as the next
    topic's products are known; the vectors are then merged by Spark and the next round begins.
    The driver holds them as one matrix, and one size and one square per topic besides.
    """
    spark = weights.sparkSession
    sizes = materialize(sizes.select("topic_id", F.col("n").cast("long").alias("n")), "sizes")
    outliers = sizes.filter(F.col("topic_id") == OUTLIER_ID).count()
    goal = topics_to_keep(n_topics, outliers > 0, count_outlier)
    rows = sizes.filter(F.col("topic_id") != OUTLIER_ID).collect()
    alive = {r["topic_id"]: r["n"] for r in rows}
    target = {t: t for t in alive}
    if len(alive) > goal:
        vectors = materialize(
            weights.filter(F.col("topic_id") != OUTLIER_ID)
            .select("topic_id", "term", (F.col("n") * F.col("idf")).alias("value")),
            "merge-vectors",
        )
    while len(alive) > goal:
        order = sorted(alive, key=lambda t: (alive[t], -t))
        asked = order[: max(2, cells // len(order))]
        ids = np.array(sorted(alive), np.int64)
        if len(asked) == len(order):
            # All pairs and squares in one pass over the terms that topics share.
            asked = ids.tolist()
            products = _matrix(topic_products(vectors), asked, ids)
            products += np.triu(products, 1).T
            squares = products.diagonal().copy()
            np.fill_diagonal(products, 0.0)
        else:
            wanted = spark.createDataFrame([(t,) for t in asked], "topic_id int")
            own = vectors.groupBy("topic_id").agg(F.sum(F.col("value") * F.col("value")).alias("g"))
            squares = _matrix(own.select(F.lit(0).alias("a"), F.col("topic_id").alias("b"), "g"), [0], ids)[0]
            products = _matrix(topic_products(vectors, wanted), asked, ids)
        merged = _merge_known(alive, ids, squares, asked, products, goal)
        if len(alive) > goal:
            moves = spark.createDataFrame(list(merged.items()), "topic_id int, into int")
            vectors = materialize(
                vectors.join(moves, "topic_id", "left")
                .groupBy(F.coalesce("into", "topic_id").alias("topic_id"), "term").agg(F.sum("value").alias("value")),
                "merge-vectors",
            )
        target = {t: merged.get(now, now) for t, now in target.items()}
    target[OUTLIER_ID] = OUTLIER_ID
    final = spark.createDataFrame(list(target.items()), "topic_id int, new_id int")
    return sizes.select("topic_id").join(final, "topic_id")


def _matrix(products: DataFrame, rows: list[int], ids: np.ndarray) -> np.ndarray:
    """The numbers g of (a, b, g), a row for each a of ``rows`` and a column for each b of the rising ``ids``.

    They come as Arrow batches and fill the matrix batch by batch; a row object a number would take 30 times its room.
    """
    found = np.zeros((len(rows), len(ids)))
    order = np.argsort(rows)
    known = np.array(rows, np.int64)[order]
    table = products.select(F.col("a").cast("int"), F.col("b").cast("int"), "g").toArrow()
    for batch in table.to_batches():
        a, b, g = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        i = np.minimum(np.searchsorted(known, a), len(known) - 1)
        j = np.minimum(np.searchsorted(ids, b), len(ids) - 1)
        held = (known[i] == a) & (ids[j] == b)
        found[order[i[held]], j[held]] = g[held]
    return found


def _merge_known(
    alive: dict[int, int], ids: np.ndarray, squares: np.ndarray, asked: list[int], products: np.ndarray, goal: int,
) -> dict[int, int]:
    """Merge smallest topics while their products are known; changes the sizes in ``alive``.

    ``products`` has a row for each of ``asked`` and a column for each of the rising ``ids``; both it and
    ``squares`` change. A merged topic keeps the row of its partner, to which the row of the smaller one
    is added, if both are known. Returns topic to partner.
    """
    queue = [(n, -t) for t, n in alive.items()]
    heapq.heapify(queue)
    place = {t: i for i, t in enumerate(ids.tolist())}
    rows = {t: i for i, t in enumerate(asked)}
    left = np.ones(len(ids), bool)
    into: dict[int, int] = {}
    while len(alive) > goal:
        n, victim = heapq.heappop(queue)
        victim = -victim
        if alive.get(victim) != n:
            continue  # merged meanwhile, or grown
        if victim not in rows:
            break
        row, gone = products[rows.pop(victim)], place[victim]
        own = squares[gone]
        left[gone] = False
        score = np.where(left, np.round(row / np.maximum(np.sqrt(own * squares), 1e-300), 9), -np.inf)
        # Of equal ones the first; ``ids`` rise.
        at = int(score.argmax())
        if not score[at] > 0:
            at = int(left.argmax())
        partner = int(ids[at])
        squares[at] = squares[at] + 2 * row[at] + own
        if partner in rows:
            products[rows[partner]] += row
            products[rows[partner], gone] = 0.0
        products[:, at] += products[:, gone]
        products[:, gone] = 0.0
        if partner in rows:
            products[rows[partner], at] = 0.0
        alive[partner] += alive.pop(victim)
        heapq.heappush(queue, (alive[partner], -partner))
        into[victim] = partner
    return {t: _last(into, t) for t in into}


def _last(into: dict[int, int], topic: int) -> int:
    while topic in into:
        topic = into[topic]
    return topic


def assignment_strength(topics: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(row_id, topic_id, strength): cosine of each row to the mean vector of its topic."""
    centroids = topics.groupBy("topic_id").agg(
        Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>"))).alias("m")
    ).select("topic_id", vector_to_array("m").alias("_centroid"))
    return lookup(topics, centroids, "topic_id").select(
        "row_id", "topic_id",
        cosine(F.col(vec_col).cast("array<double>"), F.col("_centroid")).alias("strength"),
    )
