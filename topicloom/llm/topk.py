"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks of bounded size, queries too, and every block of queries meets
every block of vectors in one task of its own. There each dimension has its sorted list; a
query reads its lists from the end that its sign prefers, scores what it meets for the first
time, and stops when the sum of the values last read cannot reach its k-th score any more.
The best k of each block are then ranked per query.

Cases: vectors that are null or hold null or non-finite components, and null ids, take no
part; shorter vectors count zero for what they lack; equal scores go to the smaller id;
repeated rows are candidates of their own, all rows of a query's id count as its own row, and
of several query rows with one id the smallest vector asks; an empty table gives no rows;
extra columns are ignored. Scores must fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from topicloom.scratch import materialize

K = 10
SCALE = 1024.0
#: Rows of a block of vectors and of a block of queries (expected).
VECTORS, QUERIES = 8192, 512
FIRST_DEPTH = 32


def usable(vector: Column) -> Column:
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("float"))
    )
    return vector.isNotNull() & ~bad


def quantised(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """Written vec_id, v: floor(scale * x) of the usable vectors."""
    kept = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    ints = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return materialize(kept.select("vec_id", ints.alias("v")), "topk-vectors")


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Lists:
    """The sorted lists of one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        # Products of doubles are exact below 2 ** 53, and much faster than those of longs.
        self.exact = float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        self.f = x.astype(np.float64)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact * float(np.abs(q).max(initial=0)) < 2**53:
            return (self.f[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ q

    def top(self, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, ties to smaller ids; the query's own id is out."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        seen = np.zeros(n, bool)
        rows, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            end = min(n, depth + step) if len(dims) else n
            # A positive weight reads its list from the highest value, a negative one from the lowest.
            up, down = dims[q[dims] < 0], dims[q[dims] > 0]
            met = np.concatenate([
                self.order[depth:end, up].ravel(), self.order[n - end : n - depth, down].ravel()
            ]) if len(dims) else np.arange(n)
            new = np.zeros(n, bool)
            new[met] = True
            new &= ~seen
            seen |= new
            fresh = np.flatnonzero(new & (self.ids != query))
            rows = np.concatenate([rows, fresh])
            best = np.concatenate([best, self.scores(fresh, q)])
            if len(rows) > k:
                keep = np.lexsort((self.ids[rows], -best))[:k]
                rows, best = rows[keep], best[keep]
            bound = int(self.sorted[end - 1, up] @ q[up]) + int(self.sorted[n - end, down] @ q[down])
            if len(best) == k and bound < best[-1]:
                break
            depth, step = end, step * 2
        order = np.lexsort((self.ids[rows], -best))
        return self.ids[rows[order]], best[order]


def _meet(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(queries):
            width = max(map(len, [*vectors["v"], *queries["v"]]))
            lists = Lists(vectors["vec_id"].to_numpy(), matrix(list(vectors["v"]), width))
            for query, q in zip(queries["vec_id"], matrix(list(queries["v"]), width)):
                ids, scores = lists.top(query, q, k)
                found["query_id"] += [query] * len(ids)
                found["vec_id"] += ids.tolist()
                found["score"] += scores.tolist()
        return pd.DataFrame(found, dtype=np.int64)

    return run


def top_k(rows: DataFrame, every: int = 100, k: int = K, vectors: int = VECTORS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    all_rows = quantised(rows)
    asked = all_rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_vectors = max(1, -(-all_rows.count() // vectors))
    n_queries = max(1, -(-asked.count() // queries))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_vectors))
    dealt = all_rows.withColumn("vb", block.cast("int")).withColumn("qb", many(n_queries))
    query_block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(n_queries)).cast("int")
    dealt_queries = asked.withColumn("qb", query_block).withColumn("vb", many(n_vectors))
    met = dealt.groupBy("vb", "qb").cogroup(dealt_queries.groupBy("vb", "qb")).applyInPandas(
        _meet(k), "query_id long, vec_id long, score long"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
