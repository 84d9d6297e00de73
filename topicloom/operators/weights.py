"""Terms, class-based TF-IDF, keywords and topic similarity."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from topicloom.constants import ENGLISH_STOP_WORDS, KEYWORDS_IN_DETAIL
from topicloom.functions import text as T
from topicloom.scratch import materialize

# Topics of a block; products are formed block by block.
BLOCK_TOPICS = 256
# Parts into which the terms of a pair of blocks are dealt.
TERM_PARTS = 16
# Documents whose terms meet in one group, as an average.
GROUP_DOCUMENTS = 1_000
# Text that a task counts at a time, and the word between its texts.
COUNTED_BYTES, END = 16 << 20, b"."


def with_terms(
    df: DataFrame, text_col: str, language: str = "english",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS, name: str = "terms",
) -> DataFrame:
    """Words and word pairs of each document; a pair never crosses documents."""
    words = T.prepared_words(F.col(text_col), language, stop_words)
    return df.withColumn("_words", words).withColumn(name, T.with_bigrams(F.col("_words"))).drop("_words")


def class_term_counts(
    topics: DataFrame, text_col: str, language: str = "english",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS, added: bool = True,
) -> DataFrame:
    """(topic_id, term, n) of words and word pairs over all rows, outliers as a class too.

    English texts are cut and counted in tasks on Arrow batches, so only a task's counts reach the
    shuffle; without ``added`` these are returned, for a step that adds them up. In other languages each word is counted together with its successor; the counts of
    single words then follow from those of the pairs.
    """
    if language == "english":
        kind = topics.schema["topic_id"].dataType.simpleString()
        rows = topics.select("topic_id", F.col(text_col).cast("string").cast("binary").alias("text"))
        found = rows.mapInArrow(_count_terms(stop_words), f"topic_id {kind}, term string, n bigint")
        return found.groupBy("topic_id", "term").agg(F.sum("n").alias("n")) if added else found
    words = topics.select(
        "topic_id", T.prepared_words(F.col(text_col), language, stop_words).alias("word")
    )
    successors = F.slice("word", F.lit(2), F.greatest(F.size("word") - 1, F.lit(0)))
    pairs = (
        # A plain explode would make the planner repeat the whole expression in a size filter.
        words.select("topic_id", F.explode_outer(F.arrays_zip("word", successors.alias("next"))).alias("p"))
        .select("topic_id", "p.word", "p.next").filter("word IS NOT NULL")
        .groupBy("topic_id", "word", "next")
        .agg(F.count("*").alias("n"), F.count("next").alias("followed"))
    )
    # Always true; without it the planner prunes ``followed`` here and aggregates the texts twice.
    singles = pairs.filter("n >= followed").groupBy("topic_id", F.col("word").alias("term")).agg(F.sum("n").alias("n"))
    return singles.union(
        # On the count, because a filter on the key would split the shared aggregation.
        pairs.filter("followed > 0")
        .select("topic_id", F.concat("word", F.lit(" "), "next").alias("term"), "n")
    )


class _Vocabulary(dict):
    """Numbers of words from 2; stop words and single characters are 0, the end of a text is 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self) if len(word) > 1 else 0
        return found


def _count_terms(stop_words: Sequence[str]):
    """Per task and topic: counts of words and word pairs, as ``text.prepared_words`` cuts them."""
    known = {END: 1, b"": 0} | {w.encode(): 0 for w in stop_words}
    upper, lower = ascii_uppercase.encode(), T.ascii_lowercase.encode()
    table = bytes.maketrans(upper + b"\n\t", lower + b"  ")
    dropped = bytes(set(range(256)) - set(upper + lower + T.digits.encode() + b" \n\t"))
    empty = T.EMPTY_DOCUMENT.encode()

    def counted(topics: list, texts: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
        places: dict = {}
        topic = np.array([places.setdefault(t, len(places)) for t in topics], np.int64)
        words = _Vocabulary(known)
        # Every text ends with a word that no prepared text has.
        every = (b" " + END + b" ").join(texts).split(b" ")
        ids = np.fromiter(map(words.__getitem__, every), np.int64, len(every))
        ids = ids[ids > 0]
        of = topic[np.cumsum(ids == 1)]
        n = len(words)
        inside = ids > 1
        paired = inside[:-1] & inside[1:]
        single, times = np.unique(of[inside] * n + ids[inside], return_counts=True)
        pair, pair_times = np.unique((of[:-1] * n + ids[:-1])[paired] * n + ids[1:][paired], return_counts=True)
        names = pa.array(words, pa.binary())
        # The place of a word among the names is its number, unless it came with the stop words.
        numbers = np.fromiter(words.values(), np.int64, n)
        place = np.zeros(n + 1, np.int64)
        place[numbers] = np.arange(n)
        term = lambda at: names.take(pa.array(place[at]))
        pairs = pc.binary_join_element_wise(term(pair // n % n), term(pair % n), pa.scalar(b" ", pa.binary()))
        held = pa.array(list(places), kind).take(pa.array(np.concatenate([single // n, pair // n // n])))
        return pa.RecordBatch.from_arrays([
            held, pa.concat_arrays([term(single % n), pairs]).cast(pa.string()),
            pa.array(np.concatenate([times, pair_times]), pa.int64()),
        ], names=["topic_id", "term", "n"])

    def run(batches):
        topics, texts, size, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for topic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text is None:
                    continue
                text = text.translate(table, dropped) or empty
                if texts and size + len(text) > COUNTED_BYTES:
                    yield counted(topics, texts, kind)
                    topics, texts, size = [], [], 0
                topics.append(topic)
                texts.append(text)
                size += len(text) + 3
        if texts:
            yield counted(topics, texts, kind)

    return run


def class_terms(
    topics: DataFrame, text_col: str, language: str = "english",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS, documents: int = 0,
) -> DataFrame:
    """(term, corpus, held): the count of each term over all rows and (topic_id, n) of its topics.

    The counts of ``class_term_counts`` with all topics of a term in one row, so that topics merge
    without a shuffle. Terms meet in groups by their hash, more of them for more ``documents``.
    """
    counts = class_term_counts(topics, text_col, language, stop_words, added=False)
    group = F.pmod(F.xxhash64("term"), F.lit(1 + documents // GROUP_DOCUMENTS)).alias("group")
    return counts.select(F.col("topic_id").cast("int"), "term", "n", group).groupBy("group").applyInArrow(
        _add_counts, "term string, corpus bigint, held array<struct<topic_id:int,n:bigint>>"
    )


def _add_counts(rows: pa.Table) -> pa.Table:
    """One row for each term, with the sum of its counts in each topic."""
    term = rows["term"].combine_chunks().dictionary_encode()
    code, topic, n = term.indices.to_numpy(), rows["topic_id"].to_numpy(), rows["n"].to_numpy()
    order = np.lexsort((topic, code))
    code, topic, n = code[order], topic[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(topic) != 0)]))
    code, topic, n = code[first], topic[first], np.add.reduceat(n, first)
    start = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))
    held = pa.StructArray.from_arrays([pa.array(topic, pa.int32()), pa.array(n, pa.int64())], names=["topic_id", "n"])
    return pa.table({
        "term": term.dictionary, "corpus": pa.array(np.add.reduceat(n, start), pa.int64()),
        "held": pa.ListArray.from_arrays(pa.array(np.append(start, len(code)), pa.int32()), held),
    })


def held_counts(terms: DataFrame) -> DataFrame:
    """(topic_id, term, n, corpus): one row for each topic of a term."""
    return terms.select("term", "corpus", F.explode_outer("held").alias("h")).select("h.topic_id", "term", "h.n", "corpus")


def merged_counts(terms: DataFrame, merges: DataFrame) -> DataFrame:
    """As ``held_counts`` after topics have merged, ``merges`` is (topic_id, new_id).

    The counts of a term add up within its row. Every task holds one id per topic.
    """
    rows = merges.select(F.col("topic_id").cast("long"), F.col("new_id").cast("int")).orderBy("topic_id").toArrow()
    old, new = (rows[c].to_numpy() for c in ("topic_id", "new_id"))

    def run(batches):
        for batch in batches:
            held = batch.column(2)
            at = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
            topic, n = (held.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            into = new[np.searchsorted(old, topic)]
            order = np.lexsort((into, at))
            at, into = at[order], into[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(into) != 0)])[: len(at)])
            if len(first):
                who = pa.array(at[first])
                yield pa.RecordBatch.from_arrays([
                    pa.array(into[first], pa.int32()), batch.column(0).take(who),
                    pa.array(np.add.reduceat(n[order], first), pa.int64()), batch.column(1).take(who),
                ], names=["topic_id", "term", "n", "corpus"])

    return terms.select("term", "corpus", "held").mapInArrow(run, "topic_id int, term string, n bigint, corpus bigint")


def topic_terms(counts: DataFrame) -> DataFrame:
    """(topic_id, topic_terms): the number of terms of each topic."""
    return counts.groupBy("topic_id").agg(F.sum("n").alias("topic_terms"))


def with_idf(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``counts`` (topic_id, term, n, corpus) with idf; ``totals`` is a written table of ``topic_terms``."""
    average = totals.agg(F.floor(F.avg("topic_terms")).alias("a")).scalar()
    return counts.withColumn("idf", F.log(1 + average / F.col("corpus")))


def weighted(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(topic_id, term, n, idf, weight) of ``counts`` (topic_id, term, n, corpus)."""
    return with_idf(counts, totals).join(totals, "topic_id").select(
        "topic_id", "term", "n", "idf",
        (F.col("n") / F.col("topic_terms") * F.col("idf")).alias("weight"),
    )


def ctfidf(counts: DataFrame) -> DataFrame:
    """(topic_id, term, n, idf, weight): share of the term in its topic times ln(1 + A / f).

    A is the whole-number mean of terms per topic, f the count of the term over all topics.
    Give it a written table: the counts are read twice.
    """
    # At most one row per topic shares a term. Sorting by a hash first spares comparing long common beginnings.
    corpus = F.sum("n").over(Window.partitionBy(F.xxhash64("term"), "term"))
    return weighted(counts.withColumn("corpus", corpus), materialize(topic_terms(counts), "topic-terms"))


def topic_keywords(weights: DataFrame, k: int = KEYWORDS_IN_DETAIL) -> DataFrame:
    """(topic_id, rank, term, weight): the heaviest terms, ties in term order.

    Give it a written table: the weights are read twice.
    """
    # At least k terms of a topic reach the k-th largest of its parts' maxima, so the rest needs no sorting.
    part = F.pmod(F.xxhash64("term"), F.lit(16 * k)).alias("_part")
    tops = weights.groupBy("topic_id", part).agg(F.max("weight").alias("_top")).groupBy(F.col("topic_id").alias("_topic"))
    limits = materialize(
        tops.agg(F.get(F.sort_array(F.collect_list("_top"), False), F.lit(k - 1)).alias("_limit")), "keyword-limits"
    )
    order = Window.partitionBy("topic_id").orderBy(F.desc(F.round("weight", 12)), "term")
    return (
        weights.join(limits, F.col("topic_id").eqNullSafe(F.col("_topic")))
        .filter("_limit IS NULL OR weight >= _limit - 2e-12").select("topic_id", "term", "weight")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("topic_id", "rank", "term", "weight")
    )


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """(topic_id, words): the ranked terms as one array."""
    return (
        keywords.groupBy("topic_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("ranked"))
        .select("topic_id", F.col("ranked.term").alias("words"))
    )


def topic_products(vectors: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(a, b, g): inner products of topics over their terms, where they share any.

    ``vectors`` is a written table (topic_id, term, value). All pairs a < b and the squares
    a = b; with ``wanted`` (topic_id) only the rows of those topics, a in ``wanted``, b any other.
    Topics are dealt into blocks of about ``BLOCK_TOPICS``, so a term has one row per block that
    holds it. The rows of a term meet pairwise, and every task adds them into one small matrix
    per pair of blocks; no pair of topics is emitted per term. Terms of a pair of blocks are
    dealt into ``TERM_PARTS``, so that no pair is the work of one task.
    """
    topic = F.col("topic_id").cast("bigint")
    ids = materialize(vectors.select(topic.alias("topic")).distinct(), "topic-ids")
    blocks = max(1, -(-ids.count() // BLOCK_TOPICS))
    block = F.pmod(F.xxhash64(F.lit(3), "topic"), F.lit(blocks)).cast("int")
    rows = vectors.select(topic.alias("topic"), "term", F.col("value").cast("double")).withColumn("block", block)

    def pieces(of: DataFrame, side: str) -> DataFrame:
        return of.groupBy("term", "block").agg(
            F.collect_list("topic").alias(f"t{side}"), F.collect_list("value").alias(f"v{side}")
        ).select("term", F.col("block").alias(f"b{side}"), f"t{side}", f"v{side}")

    if wanted is None:
        # Most terms have one topic; they take part in its square only.
        shared = rows.join(rows.groupBy("term").agg(F.count("*").alias("_n")).filter("_n > 1").select("term"), "term")
        left = materialize(pieces(shared, "a"), "term-pieces")
        right = left.toDF("term", "bb", "tb", "vb")
        met = left.join(right, "term").filter("ba <= bb")
    else:
        asked = wanted.select(topic.alias("topic")).distinct()
        left = materialize(pieces(rows.join(asked, "topic"), "a"), "term-pieces")
        right = materialize(pieces(rows.join(left.select("term").distinct(), "term", "left_semi"), "b"), "term-pieces")
        met = left.join(right, "term")
    spot = F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS)).cast("int")
    dealt = met.select("ba", "bb", spot.alias("spot"), "ta", "va", "tb", "vb").repartition("ba", "bb", "spot")
    found = dealt.sortWithinPartitions("ba", "bb").mapInPandas(_add_blocks(wanted is None), "a bigint, b bigint, g double")
    if wanted is None:
        once = F.col("a") < F.col("b")
        within = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "g").filter(once)
        squares = rows.groupBy(F.col("topic").alias("a"), F.col("topic").alias("b")).agg(
            F.sum(F.col("value") * F.col("value")).alias("g")
        )
        return within.groupBy("a", "b").agg(F.sum("g").alias("g")).unionByName(squares)
    return found.filter("a <> b").groupBy("a", "b").agg(F.sum("g").alias("g"))


def _add_blocks(once: bool):
    """Sums of the products of topics, one matrix for each pair of blocks in turn.

    Within one block every pair is met from both sides; ``once`` keeps one of them.
    """

    def run(batches):
        pair, total = None, {}

        def found():
            i, j = np.nonzero(total["g"])
            a, b = (np.fromiter(total[side], np.int64, len(total[side]))[at] for side, at in (("a", i), ("b", j)))
            kept = a < b if once and pair[0] == pair[1] else slice(None)
            return pd.DataFrame({"a": a[kept], "b": b[kept], "g": total["g"][i, j][kept]})

        for pdf in batches:
            keys = list(zip(pdf["ba"], pdf["bb"]))
            start = 0
            while start < len(pdf):
                end = start + 1
                while end < len(pdf) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != pair:
                    if pair is not None:
                        yield found()
                    pair, total = keys[start], {"a": {}, "b": {}, "g": np.zeros((0, 0))}
                part = pdf.iloc[start:end]
                _add(total, part["ta"], part["va"], part["tb"], part["vb"])
                start = end
        if pair is not None:
            yield found()

    return run


def _add(total: dict, ta, va, tb, vb) -> None:
    """Add the products of the terms' topics to a matrix that grows with the topics met."""
    sides = []
    for name, topics, values in (("a", ta, va), ("b", tb, vb)):
        at = total[name]
        widths = topics.map(len).to_numpy()
        flat = np.concatenate(topics.to_numpy())
        for t in np.unique(flat).tolist():
            at.setdefault(t, len(at))
        column = np.fromiter((at[t] for t in flat.tolist()), np.int64, len(flat))
        sides.append((np.repeat(np.arange(len(topics)), widths), column, np.concatenate(values.to_numpy()), len(at)))
    old = total["g"]
    total["g"] = np.zeros((sides[0][3], sides[1][3]))
    total["g"][: old.shape[0], : old.shape[1]] = old
    step = max(1, (1 << 22) // max(1, sides[0][3] + sides[1][3]))
    for start in range(0, len(ta), step):
        dense = []
        for row, column, values, size in sides:
            inside = slice(*np.searchsorted(row, [start, start + step]))
            block = np.zeros((min(step, len(ta) - start), size))
            block[row[inside] - start, column[inside]] = values[inside]
            dense.append(block)
        total["g"] += dense[0].T @ dense[1]


def topic_similarity(weights: DataFrame) -> DataFrame:
    """(topic_a, topic_b, similarity) for a < b: cosine of the topics' term weights."""
    vectors = materialize(weights.select("topic_id", "term", F.col("weight").alias("value")), "topic-vectors")
    g = materialize(topic_products(vectors), "topic-products")
    squares = g.filter("a = b").select("a", F.col("g").alias("square"))
    # Topics without a common term have a similarity too.
    pairs = squares.toDF("topic_a", "square_a").join(squares.toDF("topic_b", "square_b"), F.expr("topic_a < topic_b"))
    met = g.filter("a < b").toDF("topic_a", "topic_b", "g")
    return pairs.join(met, ["topic_a", "topic_b"], "left").select(
        "topic_a", "topic_b",
        (F.coalesce("g", F.lit(0.0)) / F.sqrt(F.col("square_a") * F.col("square_b"))).alias("similarity"),
    )
