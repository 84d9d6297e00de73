"""Shard documents by balanced label propagation, law ``rows``.

Documents of equal text are linked. Each starts in a shard by the hash of its id; then, in
rounds of joins, the members of a group move to the shard where most of them are, as far as
that shard's quota allows. A group above half a shard is first split by the hash of its ids,
so that it can be spread. All state is kept per (group, starting shard), never per link.
At the end each shard above its exact quota gives documents to those below, unlinked ones
first, so that counts differ by one at most, and every document gets its place in its shard.

Cases: a null text has no bytes and counts like an empty one but is linked to no empty text
only through its size, hash and checksum, which agree, so null and empty texts form one
group; null and repeated ids are documents of their own; fewer documents than shards leave
shards empty; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from topicloom.llm.common import ranked
from topicloom.scratch import materialize

SHARDS = 16
ROUNDS = 6
#: During propagation a shard may hold linked documents up to so much more than its quota.
SLACK = 0.05
BUCKETS = 256
GROUP = ["_g", "text_crc32", "size"]
PART = [*GROUP, "_sub"]


def _of(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))


def narrow(docs: DataFrame, shards: int) -> DataFrame:
    """Written table of ids, sizes, text keys and starting shards."""
    text = F.coalesce("text", F.lit(""))
    return materialize(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_g"),
            F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(shards)).cast("int").alias("_start"),
        ),
        "shard-docs",
    )


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _per_shard(rows: DataFrame, shard: str, value: Column, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in rows.groupBy(shard).agg(value.alias("_v")).collect()}
    return [int(found.get(s) or 0) for s in range(shards)]


def propagate(parts: DataFrame, caps: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move the parts of groups towards each other. ``parts``: PART, _start, n, shard.

    A round ends when quotas let nothing move; the order in which groups are let in changes
    from round to round.
    """
    shards = len(caps)
    for turn in range(rounds):
        load = _per_shard(parts, "shard", F.sum("n"), shards)
        room = [max(0, int(c * (1 + SLACK)) - x) for c, x in zip(caps, load)]
        votes = parts.groupBy(*PART, "shard").agg(F.sum("n").alias("_votes"))
        # Equal votes are decided by group, so that ties don't all fill the same shard.
        tie = F.pmod(F.col("shard") - F.xxhash64(*PART), F.lit(shards))
        best = votes.groupBy(*PART).agg(
            F.max_by("shard", F.struct("_votes", tie)).alias("_best")
        )
        wish = parts.join(best, PART).withColumn(
            "_bucket", F.pmod(F.xxhash64(F.lit(turn), *PART), F.lit(BUCKETS))
        )
        asked = (
            wish.filter("shard <> _best").groupBy("_best", "_bucket").agg(F.sum("n").alias("_in"))
            .withColumn("_sum", F.sum("_in").over(W.partitionBy("_best").orderBy("_bucket")))
        )
        let_in = materialize(
            asked.filter(F.col("_sum") <= _of(room, F.col("_best"))).select(
                "_best", "_bucket", F.lit(True).alias("_moves")
            ),
            "shard-let-in",
        )
        if not let_in.take(1):
            break
        parts = materialize(
            wish.join(let_in, ["_best", "_bucket"], "left").select(
                *PART, "_start", "n",
                F.when(F.col("_moves"), F.col("_best")).otherwise(F.col("shard")).alias("shard"),
            ),
            "shard-parts",
        )
    return parts


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per document."""
    rows = narrow(docs, shards)
    caps = quotas(rows.count(), shards)
    half = max(1, max(caps) // 2)
    groups = materialize(
        rows.groupBy(*GROUP).agg(F.count("*").alias("_n")).filter("_n > 1")
        .withColumn("_pieces", F.ceil(F.col("_n") / half)).drop("_n"),
        "shard-groups",
    )
    piece = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.coalesce("_pieces", F.lit(1)))
    rows = materialize(
        rows.join(groups, GROUP, "left").select(
            "doc_id", *GROUP, "_start", piece.cast("int").alias("_sub"),
            F.col("_pieces").isNotNull().alias("_linked"),
        ),
        "shard-linked",
    )
    parts = materialize(
        rows.filter("_linked").groupBy(*PART, "_start").agg(F.count("*").alias("n"))
        .withColumn("shard", F.col("_start")),
        "shard-parts",
    )
    moved = propagate(parts, caps, rounds).select(*PART, "_start", F.col("shard").alias("_to"))
    placed = materialize(
        rows.join(moved, [*PART, "_start"], "left")
        .withColumn("_at", F.coalesce("_to", "_start")).drop("_to", "_start"),
        "shard-placed",
    )
    return balance(placed, caps)


def balance(placed: DataFrame, caps: list[int]) -> DataFrame:
    """Exact counts: rows above a quota leave, unlinked ones first, and fill the open places."""
    shards = len(caps)
    counts = _per_shard(placed, "_at", F.count("*"), shards)
    over = [max(0, n - c) for n, c in zip(counts, caps)]
    stay = [min(n, c) for n, c in zip(counts, caps)]
    begin = [0, *accumulate(counts)][:-1]
    out_before = [0, *accumulate(over)][:-1]
    open_before = [0, *accumulate(c - s for c, s in zip(caps, stay))][:-1]
    order = [F.col(c) for c in ("_at", "_linked", *PART, "doc_id")]
    full = ranked(placed, order, "_rank").withColumn(
        "_rank", F.col("_rank") - _of(begin, F.col("_at"))
    )
    at = F.col("_at")
    leaves = F.col("_rank") < _of(over, at)
    turn = _of(out_before, at) + F.col("_rank")
    opens = F.array(*[F.lit(v).cast("long") for v in open_before])
    goes = F.size(F.filter(opens, lambda x: x <= turn)) - 1
    return full.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(leaves, goes).otherwise(at).cast("int").alias("shard"),
        F.when(leaves, _of(stay, goes) + turn - _of(open_before, goes))
        .otherwise(F.col("_rank") - _of(over, at)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
