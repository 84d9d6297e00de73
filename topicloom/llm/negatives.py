"""Hard negatives by LEMP-style coordinate pruning.

The vectors are dealt by length into buckets of bounded size, written once. A bucket holds, for
each coordinate, its rows sorted by the value of that coordinate in the normalised vector. A
search needs rows whose inner product with an anchor reaches a threshold: the bucket's longest
vector turns it into an angle, the angle gives a range of feasible values for each of the
anchor's largest ("focus") coordinates, the sorted lists give the rows in each range, and only
rows in all of them are scored exactly. The threshold is the lower end of the wanted scores or
the last score kept so far, whichever is higher, so it rises from bucket to bucket.

Anchors go to the tasks in chunks of ``ANCHOR_BYTES``; each chunk passes over the buckets twice,
for the positives and then for the negatives. No vector is copied or shuffled per anchor.

Cases: rows with a null id or label, or a vector that is null or holds null or non-finite
components, take no part; shorter vectors count zero for what they lack; equal scores go to the
smaller id; repeated rows are candidates of their own, each with its rank, all rows of an
anchor's id count as its own row, and of several anchor rows of one id the smallest (vector,
label) asks; a positive of negative score has no negatives, as no score can satisfy both
bounds; an empty table gives no rows; extra columns are ignored. Scores must fit in 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from topicloom.llm.topk import usable
from topicloom.scratch import materialize, new_path

SCALE, EVERY = 256.0, 100
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows of a bucket; bytes of the anchors that one pass hands to every task.
BUCKET, ANCHOR_BYTES = 4096, 16 << 20
FOCUS = 4
#: Anchors whose scores against a bucket are computed together.
TOGETHER = 256
SLACK = 1e-9
NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


def prepared(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """Written vec_id, label, v (floor(scale * x)), len2 of the rows that take part."""
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    ints = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    kept = rows.filter(ok).select("vec_id", F.col("label").cast("long").alias("label"), ints.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return materialize(kept.withColumn("len2", square), "negative-rows")


def _packed(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest integer type that holds it."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def _unit(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return x / np.where(lengths > 0, lengths, 1.0)[:, None]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


BUCKETS = "n int, width int, item int, ids binary, labels binary, v binary, lists binary"


def buckets(rows: DataFrame, total: int, width: int, size: int = BUCKET) -> DataFrame:
    """Written buckets of ``rows`` by falling length, with their sorted coordinate lists."""

    def build(batches):
        def bucket(ids, labels, x):
            v = _packed(x)
            lists = np.argsort(_unit(x, _lengths(x)), axis=0, kind="stable")
            columns = {"n": len(ids), "width": width, "item": v.itemsize}
            blobs = {"ids": ids, "labels": labels, "v": v, "lists": lists.T.astype(np.uint16)}
            return pa.RecordBatch.from_pydict(
                {k: pa.array([x], pa.int32()) for k, x in columns.items()}
                | {k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in blobs.items()}
            )

        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64)]
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in (0, 1)] + [_matrix(batch.column(2), width)]
            held = [np.concatenate(x) for x in zip(held, new)]
            while len(held[0]) >= size:
                yield bucket(*[x[:size] for x in held])
                held = [x[size:] for x in held]
        if len(held[0]):
            yield bucket(*held)

    # The hash keeps rows of one length from falling into one partition.
    order = [F.desc("len2"), F.xxhash64("vec_id")]
    dealt = rows.repartitionByRange(max(1, -(-total // (4 * size))), *order).sortWithinPartitions(*order)
    return materialize(
        dealt.select("vec_id", "label", "v").mapInArrow(build, BUCKETS), "negative-buckets"
    )


class Bucket:
    def __init__(self, row: dict):
        n, width = row["n"], row["width"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.v = np.frombuffer(row["v"], f"i{row['item']}").reshape(n, width)
        self.lists = np.frombuffer(row["lists"], np.uint16).reshape(width, n)
        self.f = self.v.astype(np.float64)
        lengths = _lengths(self.v)
        self.longest = float(lengths.max(initial=0))
        unit = _unit(self.f, lengths)
        self.values = np.take_along_axis(unit.T, self.lists.astype(np.int64), axis=1)
        self.exact = float(np.abs(self.f).max(initial=0)) * max(1, width)

    def scores(self, q: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Exact inner products of anchors ``q`` with rows; doubles are exact below 2 ** 53."""
        if self.exact * float(np.abs(q).max(initial=0)) < 2**53:
            return (q.astype(np.float64) @ self.f[rows].T).astype(np.int64)
        return q @ self.v[rows].astype(np.int64).T

    def feasible(self, unit: np.ndarray, length: float, least: int) -> np.ndarray | None:
        """Rows that may score ``least`` or more with an anchor; None for all of them."""
        if least <= 0:
            return None
        reach = least / (length * self.longest) if length * self.longest > 0 else np.inf
        if reach > 1 + SLACK:
            return np.zeros(0, np.int64)
        angle = np.arccos(min(1.0, reach))
        met, used = np.zeros(len(self.ids), np.uint8), 0
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            own = np.arccos(np.clip(unit[f], -1, 1))
            low = np.cos(min(np.pi, own + angle)) - SLACK
            high = np.cos(max(0.0, own - angle)) + SLACK
            start, end = np.searchsorted(self.values[f], low, "left"), np.searchsorted(self.values[f], high, "right")
            if end - start < len(self.ids):
                met[self.lists[f, start:end]] += 1
                used += 1
        return np.flatnonzero(met == used) if used else None


@dataclass
class Anchors:
    """A chunk of anchors, and the score windows that each searches."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    #: Per window: its anchor, least and greatest score.
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    same_label: bool


FOUND = "spot int, vec_id long, score long"


def _search(shared):
    def run(batches):
        a: Anchors = shared.value
        lengths = _lengths(a.v)
        unit = _unit(a.v, lengths)
        windows = [np.flatnonzero(a.owner == i) for i in range(len(a.ids))]
        scores = [np.zeros(0, np.int64) for _ in a.owner]
        ids = [np.zeros(0, np.int64) for _ in a.owner]

        def least(i: int) -> int:
            return min(
                (max(int(a.low[w]), int(scores[w][-1])) if len(scores[w]) == a.k else int(a.low[w])
                 for w in windows[i]), default=MOST,
            )

        def take(i: int, bucket: Bucket, s: np.ndarray, rows: np.ndarray | slice) -> None:
            same = bucket.labels[rows] == a.labels[i]
            fit = (same if a.same_label else ~same) & (bucket.ids[rows] != a.ids[i])
            floor = least(i)
            at = np.flatnonzero(fit & (s >= floor))
            s, found = s[at], bucket.ids[rows][at]
            for w in windows[i]:
                inside = (s >= a.low[w]) & (s <= a.high[w])
                both = np.concatenate([scores[w], s[inside]])
                names = np.concatenate([ids[w], found[inside]])
                keep = np.lexsort((names, -both))[: a.k]
                scores[w], ids[w] = both[keep], names[keep]

        for batch in batches:
            for row in batch.to_pylist():
                bucket = Bucket(row)
                whole = []
                for i in range(len(a.ids)):
                    rows = bucket.feasible(unit[i], float(lengths[i]), least(i)) if len(windows[i]) else np.zeros(0, int)
                    if rows is None:
                        whole.append(i)
                    elif len(rows):
                        take(i, bucket, bucket.scores(a.v[i : i + 1], rows)[0], rows)
                for start in range(0, len(whole), TOGETHER):
                    part = whole[start : start + TOGETHER]
                    for i, s in zip(part, bucket.scores(a.v[part])):
                        take(i, bucket, s, slice(None))
        for w in range(len(a.owner)):
            if len(ids[w]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids[w]), w, np.int32)), pa.array(ids[w]), pa.array(scores[w])],
                    names=["spot", "vec_id", "score"],
                )

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each window over all tasks, with their rank."""
    order = W.partitionBy("spot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    bucket: int = BUCKET, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank."""
    spark = rows.sparkSession
    known = prepared(rows)
    shape = known.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    total, width = shape["n"], max(1, shape["width"] or 1)
    index = buckets(known, total, width, bucket)
    asked = known.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.min(F.struct("v", "label")).alias("a")
    ).select("vec_id", "a.*")
    n_chunks = max(1, -(-asked.count() * width * 8 // anchor_bytes))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)).cast("int")
    asked = materialize(asked.withColumn("chunk", chunk), "negative-anchors")

    def search(anchors: Anchors) -> DataFrame:
        return index.mapInArrow(_search(spark.sparkContext.broadcast(anchors)), FOUND)

    paths = []
    for c in range(n_chunks):
        part = asked.filter(F.col("chunk") == c).orderBy("vec_id").collect()
        ids = np.array([r["vec_id"] for r in part], np.int64)
        labels = np.array([r["label"] for r in part], np.int64)
        v = np.zeros((len(part), width), np.int64)
        for i, r in enumerate(part):
            v[i, : len(r["v"])] = r["v"]
        everything = np.full(len(ids), NONE), np.full(len(ids), MOST)
        own = np.arange(len(ids))
        near = _best(search(Anchors(ids, labels, v, own, *everything, positives, True)), positives)
        # At most ``positives`` rows for each anchor of the chunk.
        pairs = sorted((r["spot"], r["rank"], r["vec_id"], r["score"]) for r in near.collect())
        table = spark.createDataFrame(
            [(w, int(ids[p[0]]), p[2], p[1], p[3]) for w, p in enumerate(pairs)],
            "spot int, anchor_id long, positive_id long, positive_rank int, positive_score long",
        )
        score = [p[3] for p in pairs]
        low = np.array([-(-LOW * s // 100) for s in score], np.int64)
        high = np.array([HIGH * s // 100 for s in score], np.int64)
        owner = np.array([p[0] for p in pairs], np.int64)
        # No score lies in an empty window.
        open_ = low <= high
        low, high = np.where(open_, low, MOST), np.where(open_, high, NONE)
        far = _best(search(Anchors(ids, labels, v, owner, low, high, negatives, False)), negatives)
        paths.append(new_path(spark, "hard-negatives"))
        far.join(table, "spot").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"), "positive_rank",
        ).write.parquet(paths[-1])
    return spark.read.parquet(*paths)
