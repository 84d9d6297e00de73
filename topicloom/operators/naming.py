"""Topic names, prompts, replies, cached names and extractive summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from topicloom.constants import (
    ENGLISH_STOP_WORDS, FALLBACK_NAME_PREFIX, KEYWORDS_IN_NAME, KEYWORDS_IN_PROMPT, OUTLIER_ID,
    OUTLIER_NAME, SAMPLES_IN_SUMMARY,
)
from topicloom.functions import text as T
from topicloom.operators.joins import lookup
from topicloom.operators.reports import topic_samples
from topicloom.operators.weights import keyword_lists, with_terms
from topicloom.scratch import materialize

NAME_TEMPLATE = (
    "Strongest terms of one group of texts: {keywords}\nGive this group a short title."
)
SUMMARY_TEMPLATE = (
    "Group {name}, strongest terms: {keywords}\nSome of its texts:\n{samples}\n"
    "In one paragraph, say what these texts share and where they differ."
)

# Terms of a topic that bound the score of its sentences.
HEAVY_TERMS = 200


def fallback_name(topic_id: Column) -> Column:
    return F.concat(F.lit(FALLBACK_NAME_PREFIX), topic_id.cast("string"))


def keyword_name(topic_id: Column, words: Column, k: int = KEYWORDS_IN_NAME) -> Column:
    """The outlier label, else up to ``k`` top words, else "Topic N"."""
    return (
        F.when(topic_id == OUTLIER_ID, F.lit(OUTLIER_NAME))
        .when(F.size(words) > 0, F.array_join(F.slice(words, 1, k), " "))
        .otherwise(fallback_name(topic_id))
    )


def name_topics(topic_ids: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic_id, topic_name) for every topic, those without keywords included."""
    return topic_ids.select("topic_id").distinct().join(
        keyword_lists(keywords), "topic_id", "left"
    ).select(
        "topic_id", keyword_name(F.col("topic_id"), F.col("words")).alias("topic_name")
    )


def fill(template: str, **parts: Column) -> Column:
    """Template text with each {placeholder} replaced by a column."""
    pieces, rest = [], template
    while rest:
        starts = [(rest.find("{" + p + "}"), p) for p in parts if "{" + p + "}" in rest]
        if not starts:
            pieces.append(F.lit(rest))
            break
        at, part = min(starts)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(F.coalesce(parts[part], F.lit("")))
        rest = rest[at + len(part) + 2:]
    return F.concat(*pieces)


def topic_prompts(
    topics: DataFrame, keywords: DataFrame, names: DataFrame, text_col: str,
    name_template: str = NAME_TEMPLATE, summary_template: str = SUMMARY_TEMPLATE,
) -> DataFrame:
    """(topic_id, name_prompt, summary_prompt) of the non-outlier topics."""
    kept = topics.filter(F.col("topic_id") != OUTLIER_ID)
    samples = (
        topic_samples(kept, text_col, SAMPLES_IN_SUMMARY, by="topic_id")
        .groupBy("topic_id")
        .agg(F.array_sort(F.collect_list(F.struct("sample_no", "sample"))).alias("s"))
        .select("topic_id", T.numbered_lines(F.col("s.sample")).alias("samples"))
    )
    joined = (
        samples.join(keyword_lists(keywords), "topic_id", "left").join(names, "topic_id", "left")
    )
    words = F.array_join(F.slice("words", 1, KEYWORDS_IN_PROMPT), ", ")
    return joined.select(
        "topic_id",
        fill(name_template, keywords=words).alias("name_prompt"),
        fill(
            summary_template, name=F.col("topic_name"), keywords=words, samples=F.col("samples")
        ).alias("summary_prompt"),
    )


def resolve_names(topics: DataFrame) -> DataFrame:
    """Final name from (topic_id, words, cached, reply).

    A non-empty cached name wins; then the model's reply on one line, "Topic N" if that is
    empty; a missing reply stands for an error and gives the keyword name.
    """
    topic_id, words = F.col("topic_id"), F.col("words")
    cached = F.when(F.col("cached") != "", F.col("cached"))
    reply = T.single_line(F.col("reply"))
    answered = (
        F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, fallback_name(topic_id))
        .when(F.col("reply").isNull(), keyword_name(topic_id, words))
        .when(reply == "", fallback_name(topic_id))
        .otherwise(reply)
    )
    return topics.withColumn(
        "topic_name",
        F.when(topic_id == OUTLIER_ID, F.lit(OUTLIER_NAME)).otherwise(F.coalesce(cached, answered)),
    )


def names_to_compute(topic_ids: DataFrame, cache: DataFrame) -> DataFrame:
    """Non-outlier topics without a usable cached name."""
    usable = cache.filter(F.col("topic_name").isNotNull() & (F.col("topic_name") != ""))
    return (
        topic_ids.select("topic_id").distinct().filter(F.col("topic_id") != OUTLIER_ID)
        .join(usable.select("topic_id"), "topic_id", "left_anti")
    )


def complete(
    prompts: DataFrame, make_client: Callable[[], Callable[[list[str]], list[str | None]]],
    prompt_col: str = "name_prompt", batch_size: int = 16,
) -> DataFrame:
    """(topic_id, reply) by a user's text model, written so that no prompt is asked twice.

    ``make_client`` runs once per task and returns a function from prompts to replies. Where a
    batch fails, its prompts are asked one by one; a prompt that fails has the reply NULL, as has
    one that is NULL itself.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()

        def answers(asked: list[str]) -> list[str | None]:
            try:
                replies = list(client(asked))
                if len(replies) != len(asked):
                    raise ValueError(f"{len(replies)} replies to {len(asked)} prompts")
                return replies
            except Exception:  # a model's failure is a missing reply, which has its own name
                return [None] if len(asked) == 1 else [r for p in asked for r in answers([p])]

        for batch in batches:
            asked = [p for p in batch if p is not None]
            replies = iter([r for i in range(0, len(asked), batch_size) for r in answers(asked[i : i + batch_size])])
            yield pd.Series([None if p is None else next(replies) for p in batch], dtype=object)

    return materialize(prompts.select("topic_id", ask(F.col(prompt_col)).alias("reply")), "replies")


def names_by_model(
    topic_ids: DataFrame, keywords: DataFrame, prompts: DataFrame, cache: DataFrame,
    make_client: Callable[[], Callable[[list[str]], list[str | None]]],
) -> DataFrame:
    """(topic_id, topic_name) with a text model's names; only topics that ``cache`` lacks are asked."""
    missing = names_to_compute(topic_ids, cache)
    replies = complete(prompts.join(missing, "topic_id", "left_semi"), make_client)
    known = cache.select("topic_id", F.col("topic_name").alias("cached"))
    every = (
        topic_ids.select("topic_id").distinct().join(keyword_lists(keywords), "topic_id", "left")
        .join(known, "topic_id", "left").join(replies, "topic_id", "left")
    )
    return resolve_names(every).select("topic_id", "topic_name")


def _sentence_terms(sentence: DataFrame, language: str, stop_words: Sequence[str]) -> DataFrame:
    return (
        with_terms(sentence, "sentence", language, stop_words)
        .select("topic_id", "row_id", "sentence_no", F.explode_outer("terms").alias("term"))
        .filter("term IS NOT NULL")
    )


def sentence_bounds(
    sentence: DataFrame, weights: DataFrame, language: str, stop_words: Sequence[str],
    heavy_terms: int = HEAVY_TERMS,
) -> DataFrame:
    """Written (topic_id, row_id, sentence_no, low, high): bounds of each sentence's score.

    The heaviest terms of a topic count with their weight, each other term with nothing or with
    the weight of the next one. The terms of a sentence are added up where they are formed, so
    one narrow row of each sentence is shuffled and written.
    """
    order = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term")
    top = materialize(
        weights.select("topic_id", "term", "weight").withColumn("i", F.row_number().over(order))
        .filter(F.col("i") <= heavy_terms + 1),
        "heavy-terms",
    )
    heavy = materialize(top.filter(F.col("i") <= heavy_terms).drop("i"), "heavy-weights")
    rest = top.filter(F.col("i") > heavy_terms).select("topic_id", F.col("weight").alias("rest"))
    sums = (
        _sentence_terms(sentence, language, stop_words).join(heavy, ["topic_id", "term"], "left")
        .groupBy("topic_id", "row_id", "sentence_no")
        .agg(
            F.coalesce(F.sum("weight"), F.lit(0.0)).alias("low"),
            F.count_if(F.col("weight").isNull()).alias("light"),
        )
    )
    return materialize(
        lookup(sums, rest, "topic_id").select(
            "topic_id", "row_id", "sentence_no", "low",
            (F.col("low") + F.col("light") * F.coalesce("rest", F.lit(0.0))).alias("high"),
        ),
        "sentence-bounds",
    )


def extractive_summary(
    topics: DataFrame, weights: DataFrame, text_col: str, n_sentences: int = 3,
    samples: int | None = None, language: str = "english",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS, heavy_terms: int = HEAVY_TERMS,
) -> DataFrame:
    """(topic_id, rank, row_id, sentence_no, sentence, score): sentences with most topic weight.

    All texts of a topic are ranked, or its first ``samples`` where given. Outliers get no summary.
    Weights are not negative. Only sentences whose upper bound reaches the ``n_sentences``-th
    lower bound of their topic are scored in full; ``heavy_terms`` changes the work, not the rows.
    """
    kept = topics.filter(F.col("topic_id") != OUTLIER_ID)
    if samples is None:
        texts = kept.select("topic_id", "row_id", F.col(text_col).alias("sample"))
    else:
        texts = topic_samples(kept, text_col, samples, by="topic_id").drop("sample_no")
    sentence = texts.select(
        "topic_id", "row_id", F.posexplode_outer(T.sentences(F.col("sample")))
    ).filter("col IS NOT NULL").select("topic_id", "row_id", (F.col("pos") + 1).alias("sentence_no"), F.col("col").alias("sentence"))
    sentence = materialize(sentence, "sentences")
    bounds = sentence_bounds(sentence, weights, language, stop_words, heavy_terms)
    lowest = Window.partitionBy("topic_id").orderBy(F.desc("low"))
    needed = (
        bounds.select("topic_id", "low").withColumn("i", F.row_number().over(lowest))
        .filter(F.col("i") <= n_sentences)
        .groupBy("topic_id").agg(F.when(F.count("*") >= n_sentences, F.min("low")).otherwise(0.0).alias("needed"))
    )
    # Sums in another order may differ in their last digits.
    reach = F.col("high") * (1 + 1e-6) + 1e-6 >= F.col("needed")
    chosen = lookup(bounds, needed, "topic_id").filter(reach).select("topic_id", "row_id", "sentence_no")
    chosen = materialize(
        sentence.join(materialize(chosen, "chosen-keys"), ["topic_id", "row_id", "sentence_no"]), "chosen-sentences"
    )
    scores = (
        _sentence_terms(chosen, language, stop_words)
        .groupBy("topic_id", "row_id", "sentence_no", "term").agg(F.count("*").alias("n"))
        .join(weights.select("topic_id", "term", "weight"), ["topic_id", "term"])
        .groupBy("topic_id", "row_id", "sentence_no")
        .agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    )
    best = Window.partitionBy("topic_id").orderBy(
        F.desc(F.round("score", 9)), "row_id", "sentence_no"
    )
    ranked = (
        scores.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= n_sentences)
    )
    return ranked.join(chosen, ["topic_id", "row_id", "sentence_no"]).select(
        "topic_id", "rank", "row_id", "sentence_no", "sentence", "score"
    )
