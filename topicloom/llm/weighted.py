"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words (ASCII lower case and all that Spark's ``lower`` does),
weighted by how often they occur. For each of ``SAMPLES`` samples a term draws, from hashes of
itself and the number of the sample, r and c from Gamma(2, 1) and b from Uniform(0, 1);
t = floor(ln w / r + b), ln a = ln c - r (t - b) - r. The term of the smallest a, with its t,
is the sample, so two texts agree in a sample with the probability of their generalised
Jaccard similarity. A fingerprint is 8 hex digits per sample.

Texts are shuffled once by row key; words are exploded, counted and reduced to their minima
under that same partitioning. The text that follows a document is found through a distributed
rank of ids, and only its first half travels.

Cases: a null text is an empty one; a text without words has the fingerprint ``EMPTY`` and
likeness 1 to another such text, 0 to any other; null ids come first in the order, equal ids
are ordered by a hash of their text; repeated rows of one id and text are one document in the
order, and each returned; a single document follows itself; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from topicloom.llm.common import ranked
from topicloom.scratch import materialize

SAMPLES = 16
#: Samples that are drawn from one exploded row, so that generated methods stay small.
TOGETHER = 4
EMPTY = "-"
KEY = ["_k1", "_k2"]
LOW = (1 << 32) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and the key of a document: its id and a hash of its text."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("_k1", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn(
        "_k2", F.xxhash64(F.col("doc_id").isNull(), "text")
    )


def _uniform(bits: Column) -> Column:
    """A 32-bit number as one strictly between 0 and 1."""
    return (bits.cast("double") + 0.5) / float(1 << 32)


def _draws(term: Column, sample: Column) -> tuple[Column, Column, Column]:
    """r, ln c and b of a term in a sample."""
    first, second = F.xxhash64(sample, term), F.xxhash64(sample + 1_000, term)
    high = lambda h: _uniform(F.shiftrightunsigned(h, 32))
    low = lambda h: _uniform(h.bitwiseAND(F.lit(LOW)))
    r = -F.log(high(first) * low(first))
    c = F.log(-F.log(high(second) * low(second)))
    return r, c, _uniform(F.shiftrightunsigned(F.xxhash64(sample + 2_000, term), 32))


def _encoded(weight: Column, r: Column, c: Column, b: Column, term: Column, sample: Column) -> Column:
    """ln a in the upper bits, the sampled (term, t) in the lower 32; null without the term."""
    t = F.floor(F.log(weight.cast("double")) / r + b)
    a = c - r * (t - b) - r
    order = F.floor((a + 128.0) * float(1 << 22)).cast("long")
    what = F.xxhash64(term, sample, t).bitwiseAND(F.lit(LOW))
    return F.when(weight > 0, F.shiftleft(order, 32).bitwiseOR(what))


def signatures(texts: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """KEY, m0_k, m1_k: minima of both texts of a row. ``texts``: KEY, text, edited.

    ``texts`` must be one row per key and partitioned by it; nothing here shuffles.
    """
    versions = F.array(*[
        F.struct(F.lit(i).alias("v"), F.col(c).alias("t")) for i, c in enumerate(("text", "edited"))
    ])
    each = texts.select(*KEY, F.explode_outer(versions).alias("_x")).select(
        *KEY, F.col("_x.v").alias("_v"), F.col("_x.t").alias("_t")
    )
    words = each.select(
        *KEY, "_v", F.explode_outer(F.split(F.lower("_t"), r"[\x20\x09-\x0D]+")).alias("_word")
    ).filter("_word <> ''")
    counted = words.select(*KEY, "_v", F.xxhash64("_word").alias("_term")).groupBy(*KEY, "_term").agg(
        F.sum(1 - F.col("_v")).alias("_w0"), F.sum("_v").alias("_w1")
    )
    groups = samples // TOGETHER
    dealt = counted.withColumn("_g", F.explode_outer(F.array(*[F.lit(g) for g in range(groups)])))
    term = F.col("_term")
    drawn = dealt.select(
        *KEY, "_g", "_term", "_w0", "_w1",
        *[
            x.alias(f"_{n}{i}") for i in range(TOGETHER)
            for n, x in zip("rcb", _draws(term, F.col("_g") * TOGETHER + i))
        ],
    )
    minima = drawn.groupBy(*KEY, "_g").agg(*[
        F.min(_encoded(
            F.col(f"_w{v}"), F.col(f"_r{i}"), F.col(f"_c{i}"), F.col(f"_b{i}"), term,
            F.col("_g") * TOGETHER + i,
        )).alias(f"_m{v}_{i}")
        for v in (0, 1) for i in range(TOGETHER)
    ])
    return minima.groupBy(*KEY).agg(*[
        F.max(F.when(F.col("_g") == g, F.col(f"_m{v}_{i}"))).alias(f"m{v}_{g * TOGETHER + i}")
        for v in (0, 1) for g in range(groups) for i in range(TOGETHER)
    ])


def _text(v: int, samples: int) -> Column:
    parts = [
        F.lpad(F.lower(F.hex(F.col(f"m{v}_{i}").bitwiseAND(F.lit(LOW)))), 8, "0") for i in range(samples)
    ]
    return F.when(F.col(f"m{v}_0").isNull(), F.lit(EMPTY)).otherwise(F.concat(*parts))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of the samples in which two fingerprints agree."""
    agree = reduce(
        lambda x, y: x + y,
        [(F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8)).cast("int") for i in range(samples)],
    )
    plain = F.when((a == EMPTY) | (b == EMPTY), (a == b).cast("double"))
    return plain.otherwise(agree / float(samples))


def order_of(docs: DataFrame) -> DataFrame:
    """Written KEY, doc_id, n_chars, _many, and the key and half length of the document before."""
    distinct = materialize(
        keyed(docs).select(
            *KEY, "doc_id", F.col("doc_id").isNotNull().alias("_some"), F.char_length("text").alias("n_chars")
        ).groupBy("_some", *KEY).agg(
            F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.count("*").alias("_many")
        ),
        "cws-keys",
    )
    full = materialize(ranked(distinct, [F.col(c) for c in ("_some", *KEY)], "_rank"), "cws-order")
    n = full.count()
    before = full.select(
        ((F.col("_rank") + 1) % n).alias("_rank"), F.col("_k1").alias("_p1"), F.col("_k2").alias("_p2"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("_half"),
    )
    return materialize(full.join(before, "_rank").drop("_rank", "_some"), "cws-before")


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    order = order_of(docs)
    # Key and text only, so that both uses of the rows are the same plan and share one exchange.
    rows = keyed(docs).select(*KEY, "text")
    if order.filter("_many > 1").take(1):
        rows = rows.dropDuplicates(KEY)
    starts = rows.join(order.select(*KEY, "_p1", "_p2", "_half"), KEY).select(
        F.col("_p1").alias("_k1"), F.col("_p2").alias("_k2"), F.expr("substring(text, 1, _half)").alias("_start")
    )
    half = F.floor(F.char_length("text") / 2).cast("int")
    texts = rows.join(starts, KEY).select(
        *KEY, "text",
        F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.col("_start")).alias("edited"),
    )
    facts = texts.select(*KEY, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    prints = materialize(
        facts.join(signatures(texts.select(*KEY, "text", "edited"), samples), KEY, "left").select(
            *KEY, "edited_sha256", _text(0, samples).alias("fingerprint"),
            _text(1, samples).alias("edited_fingerprint"),
        ),
        "cws-prints",
    )
    follows = prints.join(order.select(*KEY, "_p1", "_p2"), KEY).select(
        F.col("_p1").alias("_k1"), F.col("_p2").alias("_k2"), F.col("fingerprint").alias("_next")
    )
    return (
        prints.join(order.select(*KEY, "doc_id", "n_chars", "_many"), KEY).join(follows, KEY)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_many"))))
        .select(
            "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("_next"), samples).alias("near_next"),
        )
    )
