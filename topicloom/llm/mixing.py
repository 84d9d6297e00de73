"""Mix sources to target weights: capped water-filling, then seeded repetitions.

Every source has a weight and gets ``weight * level`` words, at most ``max_epochs`` times its
size. Sources above their cap are clamped and their excess is dealt to the others by weight,
again and again until no source is above. A document is then taken ``floor(target / size)``
times, and a seeded share of the documents once more: those that come first in a hash order,
up to the place where their words come nearest to what is missing. That place is found by
sums over 256 hash buckets, over 256 buckets inside the one that holds it, and over single
hashes inside that, so no task sees a whole source.

Cases: a null text counts as no words; a null source is a source of its own, last in order;
repeated rows are documents of their own but share their fate in the last share; an empty
table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from topicloom.llm.common import fresh, ranked, WORD
from topicloom.scratch import materialize

#: Weights by place of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its words.
MAX_EPOCHS = 3
SEED = 17
SOURCE = ["_no_source", "_source"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Written narrow table: doc_id, source, size and a seeded hash of the document."""
    return materialize(
        docs.select(
            "doc_id", "source", F.col("source").isNull().alias("_no_source"),
            F.coalesce("source", F.lit("")).alias("_source"), n_words(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("_h"),
        ).withColumn("_b1", F.col("_h").bitwiseAND(F.lit(255)))
        .withColumn("_b2", F.shiftrightunsigned("_h", 8).bitwiseAND(F.lit(255))),
        "mix-sized",
    )


def fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to a written table of (source_size, weight).

    The clamped sources follow from the level alone, and the level only rises, so each round
    is one sum over the sources that brings two numbers to the driver.
    """
    cap, weight = F.col("source_size") * F.lit(float(max_epochs)), F.col("weight")
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = float(total or 0) / float(weights or 1)
    while True:
        above = cap <= weight * F.lit(level)
        clamped, free = sources.agg(
            F.sum(F.when(above, cap)), F.sum(F.when(~above, weight))
        ).first()
        higher = (total - (clamped or 0.0)) / free if free else level
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(cap, weight * F.lit(level)).cast("double"))


def targets(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source of ``sized`` documents: source_size, weight and target."""
    sources = materialize(
        docs.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")), "mix-sources"
    )
    places = ranked(sources, [F.col(c) for c in SOURCE], "_place")
    repeating = F.array(*[F.lit(float(w)) for w in weights])
    weighted = places.withColumn(
        "weight", F.element_at(repeating, (F.col("_place") % len(weights) + 1).cast("int"))
    )
    return fill(materialize(weighted.drop("_place"), "mix-weights"), max_epochs)


def _boundary(sums: DataFrame, bucket: str, open_sources: DataFrame) -> DataFrame:
    """Per source the bucket in which the running sum of sizes reaches ``_need``."""
    order = W.partitionBy(*SOURCE).orderBy(bucket)
    return (
        sums.join(open_sources, SOURCE)
        .withColumn("_until", F.col("_before") + F.sum("_sum").over(order))
        .withColumn("_from", F.col("_until") - F.col("_sum"))
        .filter((F.col("_from") < F.col("_need")) & (F.col("_until") >= F.col("_need")))
    )


def cuts(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole repetitions, and the place in hash order where the last share ends."""
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = goals.withColumn("_epochs", epochs).withColumn("_whole", F.floor("_epochs"))
    plan = materialize(
        plan.withColumn("_need", (F.col("_epochs") - F.col("_whole")) * F.col("source_size")),
        "mix-plan",
    )
    still = plan.filter("_need > 0").select(*SOURCE, "_need", F.lit(0.0).alias("_before"))
    by_bucket = docs.groupBy(*SOURCE, "_b1").agg(F.sum("size").alias("_sum"))
    first = materialize(
        _boundary(by_bucket, "_b1", still).select(*SOURCE, "_need", "_b1", F.col("_from").alias("_before")),
        "mix-first",
    )
    inside = docs.join(first.select(*SOURCE, "_b1"), [*SOURCE, "_b1"])
    second = materialize(
        _boundary(
            inside.groupBy(*SOURCE, "_b2").agg(F.sum("size").alias("_sum")), "_b2", first
        ).select(*SOURCE, "_need", "_b1", "_b2", F.col("_from").alias("_before")),
        "mix-second",
    )
    inside = docs.join(second.select(*SOURCE, "_b1", "_b2"), [*SOURCE, "_b1", "_b2"])
    third = _boundary(
        inside.groupBy(*SOURCE, "_h").agg(F.sum("size").alias("_sum")), "_h", second
    )
    # The document at the place itself is taken where that comes nearer.
    nearer = F.col("_need") - F.col("_from") >= F.col("_until") - F.col("_need")
    end = third.select(
        *SOURCE, F.col("_b1").alias("_c1"), F.col("_b2").alias("_c2"), F.col("_h").alias("_ch"),
        nearer.alias("_with"),
    )
    return materialize(plan.join(end, SOURCE, "left"), "mix-cuts")


def mix(
    docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken: one row per document."""
    narrow = sized(docs, seed)
    ends = cuts(narrow, targets(narrow, weights, max_epochs))
    earlier = (F.col("_b1") < F.col("_c1")) | (
        (F.col("_b1") == F.col("_c1"))
        & (
            (F.col("_b2") < F.col("_c2"))
            | (
                (F.col("_b2") == F.col("_c2"))
                & ((F.col("_h") < F.col("_ch")) | ((F.col("_h") == F.col("_ch")) & F.col("_with")))
            )
        )
    )
    once_more = F.coalesce(earlier, F.lit(False)).cast("long")
    return (
        narrow.join(ends, SOURCE)
        .withColumn("repeats", F.col("_whole") + once_more)
        .select(
            "doc_id", "source", "size", "source_size", "target", "repeats",
            (F.col("size") * F.col("repeats")).alias("taken"), "_h",
        )
    )


def repeated(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it."""
    counts = mix(docs, seed=seed).groupBy("doc_id", "_h").agg(F.max("repeats").alias("_times"))
    place, copy = fresh(docs, "_h"), fresh(docs, "_copy")
    keyed = docs.withColumn(place, F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")))
    joined = keyed.alias("d").join(
        counts.alias("c"),
        F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col(f"d.{place}") == F.col("c._h")),
    )
    times = F.array_repeat(F.lit(0), F.col("c._times").cast("int"))
    return joined.select(
        *[F.col("d." + "`" + c.replace("`", "``") + "`") for c in docs.columns],
        F.explode(times).alias(copy),
    ).drop(copy)
