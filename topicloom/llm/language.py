"""Language identification with interpolated Kneser-Ney character models.

One model per language, over the letters of a word between two word marks. Word counts of a
bounded sample of labelled rows give n-gram counts; every order is kept as one sorted array
of 64-bit n-gram hashes with a matrix of log probabilities, one column per language, in which
back-off is already resolved for every n-gram that any language has seen. A text gets the
language of the lowest cross-entropy per predicted character. A text whose cross-entropy is
far above what its language's sample shows is rejected: the limit is calibrated on the sample.

The sample holds all labelled rows of a language up to ``SAMPLE_ROWS`` (expected), chosen by
hash of the id, whole texts. Everything else reads every row.

Cases: a text that is null or has no letter gets ``und``, score 0, and is rejected; a null id
is never learned from and not held out; rows without a language are not learned from; with no
labelled row at all every text gets ``und``; ties go to the first language in code point
order; repeated rows are each returned; an empty table gives no rows; extra columns pass by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from topicloom.llm.common import fresh, slices, small_batches
from topicloom.scratch import materialize

ORDER = 4
#: Expected bound on the labelled rows of one language that the models are fitted on.
SAMPLE_ROWS = 1500
#: Rejection limit: this many times the spread between the median and the 95th percentile
#: of the sample's cross-entropy above that percentile.
REJECT_SPREAD = 6.0
#: Characters after which the score no longer sharpens.
SCORE_CHARS = 100
START, END = 2, 3
#: Bytes of text, and different words, that one step of scoring holds.
TOGETHER, WORDS = 3 << 20, 20_000
MULT = np.uint64(0x9E3779B97F4A7C15)
LETTERS = regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False))


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams of order 1.. ORDER that end at each character of marked words,
    the place of each character in its word, and the number of its word."""
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    marked = "".join(f"{chr(START)}{w}{chr(END)}" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    orders = [codes + np.uint64(1)]
    for _ in range(1, ORDER):
        last = np.concatenate([np.zeros(1, np.uint64), orders[-1][:-1]])
        orders.append(last * MULT + codes + np.uint64(1))
    return orders, place, word


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Counts:
    """The n-grams of one order in one language: hashes of all, of the context before the last
    character and of the suffix after the first, whether a word begins here, occurrences."""

    keys: np.ndarray
    contexts: np.ndarray
    suffixes: np.ndarray
    begins: np.ndarray
    raw: np.ndarray

    @classmethod
    def of(cls, grams: list[str], raw: np.ndarray, order: int) -> Counts:
        codes = np.array([ord(c) for g in grams for c in g], np.uint32)
        codes = codes.astype(np.uint64).reshape(len(grams), order) + np.uint64(1)

        def hashed(columns: range) -> np.ndarray:
            h = np.zeros(len(grams), np.uint64)
            for c in columns:
                h = h * MULT + codes[:, c]
            return h

        keys = hashed(range(order))
        by = np.argsort(keys)
        return cls(
            keys[by], hashed(range(order - 1))[by], hashed(range(1, order))[by],
            (codes[:, 0] == START + 1)[by], np.asarray(raw, np.float64)[by],
        )


def _kneser_ney(orders: list[Counts], characters: int):
    """Per order: probabilities of its n-grams, their contexts with back-off weight.

    Below single characters stands an even share for all ``characters`` and the unknown one.
    """
    found = []
    lower = np.zeros(0)
    for k, own in enumerate(orders, 1):
        if k < len(orders):
            # Below the highest order an n-gram counts the different characters before it.
            longer = _find(own.keys, orders[k].suffixes)
            before = np.bincount(longer[longer >= 0], minlength=len(own.keys))
            a = np.where(own.begins, own.raw, before)
        else:
            a = own.raw
        contexts, inverse = np.unique(own.contexts, return_inverse=True)
        total, kinds = np.bincount(inverse, weights=a), np.bincount(inverse)
        once, twice = (a == 1).sum(), (a == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        back = discount * kinds / total
        below = lower[_find(orders[k - 2].keys, own.suffixes)] if k > 1 else 1.0 / (characters + 1)
        lower = np.maximum(a - discount, 0) / total[inverse] + back[inverse] * below
        found.append((own.keys, lower, contexts, back))
    return found


@dataclass
class Models:
    """All languages in joint sorted hash arrays, natural logs."""

    languages: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    unknown: np.ndarray
    limits: dict[str, float]

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word in each language, and its predicted characters."""
        orders, place, word = _grams(words)
        at = np.flatnonzero(place >= 1)
        logs = np.zeros((len(at), len(self.languages)))
        open_ = np.ones(len(at), bool)
        for k in range(ORDER, 0, -1):
            todo = np.flatnonzero(open_ & (place[at] >= k - 1))
            hit = _find(self.grams[k - 1], orders[k - 1][at[todo]])
            known = todo[hit >= 0]
            logs[known] += self.logs[k - 1][hit[hit >= 0]]
            open_[known] = False
            missed = todo[hit < 0]
            if k > 1:
                context = _find(self.contexts[k - 1], orders[k - 2][at[missed] - 1])
                logs[missed[context >= 0]] += self.backs[k - 1][context[context >= 0]]
            else:
                logs[missed] += self.unknown
        sums = np.empty((len(words), len(self.languages)))
        for i in range(len(self.languages)):
            sums[:, i] = np.bincount(word[at], weights=logs[:, i], minlength=len(words))
        return sums, np.bincount(word[at], minlength=len(words))


def build(counts: dict[str, list[Counts]]) -> Models:
    """Joint arrays from the n-gram counts of each language, orders from 1."""
    languages = sorted(counts)
    characters = len(np.unique(np.concatenate([counts[x][0].keys for x in languages])))
    single = [_kneser_ney(counts[x], characters) for x in languages]
    models = Models(languages, [], [], [], [], np.zeros(len(languages)), {})
    for k in range(1, ORDER + 1):
        every = [counts[x][k - 1] for x in languages]
        keys, first = np.unique(np.concatenate([c.keys for c in every]), return_index=True)
        context = np.concatenate([c.contexts for c in every])[first]
        contexts = np.unique(context)
        logs, backs = np.empty((len(keys), len(languages))), np.zeros((len(contexts), len(languages)))
        if k > 1:
            suffix = _find(models.grams[k - 2], np.concatenate([c.suffixes for c in every])[first])
        for i, model in enumerate(single):
            own, p, own_contexts, back = model[k - 1]
            c = _find(own_contexts, contexts)
            backs[c >= 0, i] = np.log(back[c[c >= 0]])
            if k == 1:
                models.unknown[i] = backs[0, i] - np.log(characters + 1)
                logs[:, i] = models.unknown[i]
            else:
                logs[:, i] = backs[_find(contexts, context), i] + models.logs[k - 2][suffix, i]
            hit = _find(own, keys)
            logs[hit >= 0, i] = np.log(p[hit[hit >= 0]])
        models.grams.append(keys)
        models.logs.append(logs)
        models.contexts.append(contexts)
        models.backs.append(backs)
    return models


def count(sample: DataFrame) -> dict[str, list[Counts]]:
    """n-gram counts per language of (lang, text), counted by Spark."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    marked = F.concat(F.lit(chr(START)), "word", F.lit(chr(END)))
    distinct = (
        sample.select("lang", F.explode(words).alias("word"))
        .groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("marked", marked)
    )
    ends = distinct.select(
        "lang", "n", "marked", F.explode(F.sequence(F.lit(2), F.char_length("marked"))).alias("end")
    )
    each = F.array(*[
        F.when(F.col("end") >= k, F.substring("marked", F.col("end") - k + 1, F.lit(k)))
        for k in range(1, ORDER + 1)
    ])
    grams = ends.select("lang", "n", F.explode(each).alias("gram")).filter("gram is not null")
    rows = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    rows["k"] = rows["gram"].str.len()
    found: dict[str, list[Counts]] = {}
    for lang, part in rows.groupby("lang"):
        by_order = [part[part["k"] == k] for k in range(1, ORDER + 1)]
        found[lang] = [Counts.of(list(g["gram"]), g["n"].to_numpy(), k) for k, g in enumerate(by_order, 1)]
    return found


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Models:
    """Fit on labelled rows that are not held out; the driver gets the sample's n-gram counts."""
    labelled = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & ~held_out(F.col("doc_id"))
    )
    per_language = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not per_language:
        return Models([], [], [], [], [], np.zeros(0), {})
    share = F.create_map(*[
        F.lit(x) for r in per_language for x in (r["lang"], min(1.0, sample_rows / r["n"]))
    ])
    dice = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = materialize(
        labelled.filter(dice < share[F.col("lang")]).select("doc_id", "text", "lang"), "language-sample"
    )
    counts = count(sample)
    models = build(counts) if counts else Models([], [], [], [], [], np.zeros(0), {})
    if counts:
        scored = predict(sample.select("doc_id", "text"), models).filter("lang_pred <> 'und'")
        for r in scored.groupBy("lang_pred").agg(
            F.percentile("cross_entropy", F.array(F.lit(0.5), F.lit(0.95))).alias("q")
        ).collect():
            half, most = r["q"]
            models.limits[r["lang_pred"]] = most + REJECT_SPREAD * max(most - half, 0.05)
    return models


def _score(texts: pa.Array, models: Models) -> pa.StructArray:
    pieces = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(pieces.flatten())
    offsets = pieces.offsets.to_numpy()
    n, languages = len(texts), models.languages
    kinds = coded.dictionary.to_pylist()
    parts = [LETTERS.findall(x.lower()) for x in kinds]
    words = sorted({w for p in parts for w in p})
    of = {w: i for i, w in enumerate(words)}
    index = np.fromiter((of[w] for p in parts for w in p), np.int64)
    owner = np.repeat(np.arange(len(kinds)), [len(p) for p in parts])
    codes = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    totals, chars = np.zeros((n, len(languages))), np.zeros(n)
    if words and languages:
        scored = [models.word_scores(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]
        sums, lengths = (np.concatenate(x) for x in zip(*scored))
        count = np.bincount(owner, weights=lengths[index], minlength=len(kinds))
        chars = np.bincount(doc, weights=count[codes], minlength=n)
        for i in range(len(languages)):
            kind = np.bincount(owner, weights=sums[index, i], minlength=len(kinds))
            totals[:, i] = np.bincount(doc, weights=kind[codes], minlength=n)
    found = chars > 0
    entropy = -totals / np.maximum(chars, 1)[:, None]
    if languages:
        best = entropy.argmin(1)
        lowest = entropy[np.arange(n), best]
        sharp = np.minimum(chars, SCORE_CHARS)[:, None]
        score = 1.0 / np.exp(-(entropy - lowest[:, None]) * sharp).sum(1)
        limit = np.array([models.limits.get(x, np.inf) for x in languages])[best]
    else:
        best, lowest, score, limit = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n)
    names = np.array([*languages, "und"], dtype=object)
    return pa.StructArray.from_arrays([
        pa.array(names[np.where(found, best, len(languages))], pa.string()),
        pa.array(np.where(found, score, 0.0), pa.float64()),
        pa.array(np.where(found, lowest, 0.0), pa.float64(), mask=~found),
        pa.array(~found | (lowest > limit), pa.bool_()),
    ], names=["lang_pred", "score", "cross_entropy", "rejected"])


def guess(docs: DataFrame, models: Models) -> Column:
    """Column of lang_pred, score, cross_entropy, rejected; only the text goes to Python."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [_score(part.column(0), shared.value) for part in slices(batch, 0, TOGETHER)]
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(parts) if parts else _score(texts, shared.value)

    return run(F.coalesce(F.col("text").cast("string"), F.lit("")))


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected."""
    return docs.select("doc_id", guess(docs, models).alias("_guess")).select("doc_id", "_guess.*")


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected; one row per document."""
    models = fit(docs, sample_rows)
    return predict(docs, models).withColumn("held_out", held_out(F.col("doc_id")))


def recognised(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose language is recognised, with their own columns."""
    models = fit(docs, sample_rows)
    mark = fresh(docs, "_rejected")
    marked = docs.withColumn(mark, guess(docs, models)["rejected"])
    return marked.filter(~F.col(mark)).drop(mark)
