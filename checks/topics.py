"""Text preparation, terms, weights, names, prompts, summaries and topic bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import (
    COUNTS_SQL, GIVEN_SQL, KEYWORDS_SQL, NAMED_SQL, STOP_SQL, WEIGHTS_SQL, check, given,
    named, table,
)
from topicloom.constants import ENGLISH_STOP_WORDS, OUTLIER_NAME
from topicloom.functions import text as T
from topicloom.functions.numeric import one_decimal
from topicloom.operators import clusters, naming, reports, weights
from topicloom.scratch import materialize

PREPARED_DOCS_SQL = """
docs AS (
  SELECT doc_id, lang, text, CASE WHEN p = '' THEN 'emptydoc' ELSE p END AS prepared FROM (
    SELECT *, regexp_replace(translate(text, chr(10) || chr(9), '  '), '[^A-Za-z0-9 ]+', '', 'g')
      AS p FROM documents))
"""
DOC_WORDS_SQL = PREPARED_DOCS_SQL + f""",
doc_words AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(prepared), '[a-z0-9_]{{2,}}'),
    lambda x: x NOT IN ({STOP_SQL})) AS w FROM docs)
"""


@check("prepare_text", f"WITH {PREPARED_DOCS_SQL} SELECT doc_id, prepared FROM docs")
def prepare_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.prepare(F.col("text")).alias("prepared")
    )


_TOKENS_SQL = """
SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (
  SELECT doc_id, regexp_extract_all(lower({0}), '{1}') AS t FROM {2})"""


@check("tokenize", f"WITH {PREPARED_DOCS_SQL}" + _TOKENS_SQL.format(
    "prepared", "[a-z0-9_]{2,}", "docs"))
def tokenize(spark, sf_dir):
    found = T.tokens(T.prepare(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("t")).select(
        "doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


@check("tokenize_unicode", _TOKENS_SQL.format(
    "translate(text, chr(10) || chr(9), '  ')", r"[\p{L}\p{N}_]{2,}", "documents"))
def tokenize_unicode(spark, sf_dir):
    found = T.tokens(T.prepare(F.col("text"), "any"), "any")
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("t")).select(
        "doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


@check("remove_stopwords", f"""
WITH {DOC_WORDS_SQL} SELECT doc_id, array_to_string(w, ' ') AS words FROM doc_words""")
def remove_stopwords(spark, sf_dir):
    words = T.drop_stop_words(T.tokens(T.prepare(F.col("text"))), ENGLISH_STOP_WORDS)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("words"))


@check("ngrams_1_2", f"""
WITH {DOC_WORDS_SQL} SELECT doc_id, len(t) AS n_terms, array_to_string(t, '|') AS terms FROM (
  SELECT doc_id, list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1])) AS t FROM doc_words)""")
def ngrams(spark, sf_dir):
    return weights.with_terms(table(spark, sf_dir, "documents"), "text").select(
        "doc_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms")
    )


@check("scalar_text_pack", """
SELECT doc_id, length(text) AS n_chars, substring(text, 1, 100) || '...' AS preview,
  array_to_string([lang, source], ', ') AS joined,
  '1. ' || lang || chr(10) || '2. ' || source AS numbered,
  coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END), ''),
    'Topic ' || doc_id) AS name_or_default,
  least(15, greatest(2, n_chars // 3)) AS bounded,
  CAST(trunc(n_chars / 7) AS BIGINT) AS whole,
  format('{:.1f}', n_chars / 8) AS one_decimal,
  CAST(n_chars AS VARCHAR) AS as_text
FROM documents""")
def scalar_text_pack(spark, sf_dir):
    n = F.col("n_chars")
    name = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").alias("n_chars"), T.preview(F.col("text")).alias("preview"),
        F.concat_ws(", ", "lang", "source").alias("joined"),
        T.numbered_lines(F.array("lang", "source")).alias("numbered"),
        F.coalesce(
            F.nullif(T.single_line(name), F.lit("")), naming.fallback_name(F.col("doc_id"))
        ).alias("name_or_default"),
        F.least(F.lit(15), F.greatest(F.lit(2), F.floor(n / 3))).alias("bounded"),
        (n / 7).cast("long").alias("whole"),
        one_decimal(n / 8).alias("one_decimal"), n.cast("string").alias("as_text"),
    )


# Terms and weights of the given topics


def counts(spark, sf_dir):
    return weights.class_term_counts(given(spark, sf_dir), "review")


def fitted(spark, sf_dir):
    """Weights of the given topics, written once for the steps that read them again."""
    return materialize(weights.ctfidf(materialize(counts(spark, sf_dir), "counts")), "weights")


@check("class_term_counts", f"""
WITH {GIVEN_SQL}, {COUNTS_SQL} SELECT topic_id, term, n FROM counts""")
def class_term_counts(spark, sf_dir):
    return counts(spark, sf_dir)


@check("ctfidf", f"""
WITH {GIVEN_SQL}, {WEIGHTS_SQL}
SELECT topic_id, term, n, round(idf, 9) AS idf, round(weight, 12) AS weight FROM weights""")
def ctfidf(spark, sf_dir):
    return weights.ctfidf(materialize(counts(spark, sf_dir), "counts")).select(
        "topic_id", "term", "n", F.round("idf", 9).alias("idf"),
        F.round("weight", 12).alias("weight"),
    )


@check("topic_keywords", f"""
WITH {GIVEN_SQL}, {KEYWORDS_SQL}
SELECT topic_id, rank, term, round(weight, 9) AS weight FROM keywords""")
def topic_keywords(spark, sf_dir):
    return weights.topic_keywords(fitted(spark, sf_dir)).withColumn(
        "weight", F.round("weight", 9)
    )


@check("topic_similarity", f"""
WITH {GIVEN_SQL}, {WEIGHTS_SQL},
gram AS (SELECT x.topic_id AS a, y.topic_id AS b, sum(x.weight * y.weight) AS g
  FROM weights x JOIN weights y ON x.term = y.term GROUP BY 1, 2)
SELECT p.a AS topic_a, p.b AS topic_b, round(p.g / sqrt(i.g * j.g), 9) AS similarity
FROM gram p JOIN gram i ON i.a = p.a AND i.b = p.a JOIN gram j ON j.a = p.b AND j.b = p.b
WHERE p.a < p.b""")
def topic_similarity(spark, sf_dir):
    return weights.topic_similarity(fitted(spark, sf_dir)).withColumn(
        "similarity", F.round("similarity", 9)
    )


def _merge_steps(n: int) -> str:
    """SQL that merges the smallest topic into its most similar one, ``n`` times."""
    steps = ["""
g0 AS (SELECT x.topic_id AS a, y.topic_id AS b, sum(x.n * x.idf * y.n * y.idf) AS g
  FROM weights x JOIN weights y ON x.term = y.term
  WHERE x.topic_id <> -1 AND y.topic_id <> -1 GROUP BY 1, 2),
s0 AS (SELECT topic_id, count(*) AS n FROM given WHERE topic_id <> -1 GROUP BY 1),
m0 AS (SELECT DISTINCT topic_id, topic_id AS new_id FROM given)"""]
    for i in range(n):
        steps.append(f"""
v{i} AS (SELECT topic_id AS victim FROM s{i} ORDER BY n, topic_id DESC LIMIT 1),
t{i} AS (SELECT p.b AS target FROM g{i} p JOIN v{i} ON p.a = victim AND p.b <> victim
  JOIN g{i} q ON q.a = p.a AND q.b = p.a JOIN g{i} r ON r.a = p.b AND r.b = p.b
  ORDER BY round(p.g / sqrt(q.g * r.g), 9) DESC, p.b LIMIT 1),
g{i + 1} AS (SELECT CASE WHEN a = victim THEN target ELSE a END AS a,
    CASE WHEN b = victim THEN target ELSE b END AS b, sum(g) AS g
  FROM g{i}, v{i}, t{i} GROUP BY 1, 2),
s{i + 1} AS (SELECT CASE WHEN topic_id = victim THEN target ELSE topic_id END AS topic_id,
  sum(n) AS n FROM s{i}, v{i}, t{i} GROUP BY 1),
m{i + 1} AS (SELECT topic_id, CASE WHEN new_id = victim THEN target ELSE new_id END AS new_id
  FROM m{i}, v{i}, t{i})""")
    return ",".join(steps)


@check("reduce_topics", f"""
WITH {GIVEN_SQL}, {WEIGHTS_SQL}, {_merge_steps(5)} SELECT topic_id, new_id FROM m5""")
def reduce_topics(spark, sf_dir):
    sizes = given(spark, sf_dir).groupBy("topic_id").agg(F.count("*").alias("n"))
    return clusters.reduce_topics(fitted(spark, sf_dir), sizes, n_topics=5)


@check("renumber_topics", f"""
WITH {GIVEN_SQL},
sizes AS (SELECT topic_id, count(*) AS n FROM given GROUP BY 1),
ranks AS (SELECT topic_id, row_number() OVER (ORDER BY n DESC, topic_id) - 1 AS new_id
  FROM sizes WHERE topic_id <> -1 UNION ALL SELECT -1, -1)
SELECT row_id, new_id AS topic_id FROM given JOIN ranks ON given.topic_id = ranks.topic_id""")
def renumber_topics(spark, sf_dir):
    return clusters.renumber_topics(given(spark, sf_dir).select("row_id", "topic_id"))


@check("small_cluster_outliers", f"""
WITH {GIVEN_SQL},
sizes AS (SELECT topic_id, count(*) AS n FROM given GROUP BY 1),
typical AS (SELECT floor(avg(n)) AS n FROM sizes)
SELECT row_id, CASE WHEN s.n < t.n THEN -1 ELSE g.topic_id END AS topic_id
FROM given g JOIN sizes s ON g.topic_id = s.topic_id, typical t""")
def small_cluster_outliers(spark, sf_dir):
    rows = given(spark, sf_dir).select("row_id", "topic_id")
    typical = rows.groupBy("topic_id").count().agg(F.floor(F.avg("count")).alias("n"))
    return clusters.small_to_outliers(rows, typical.scalar())


@check("assignment_strength", f"""
WITH {GIVEN_SQL},
cells AS (SELECT row_id, topic_id, unnest(range(1, len(embedding) + 1)) AS i,
  unnest(CAST(embedding AS DOUBLE[])) AS x FROM given),
centroids AS (SELECT topic_id, i, avg(x) AS m FROM cells GROUP BY 1, 2)
SELECT c.row_id, c.topic_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS strength
FROM cells c JOIN centroids t ON c.topic_id = t.topic_id AND c.i = t.i GROUP BY 1, 2""")
def assignment_strength(spark, sf_dir):
    return clusters.assignment_strength(given(spark, sf_dir).filter("embedding IS NOT NULL")).withColumn(
        "strength", F.round("strength", 6)
    )


# Names, prompts, summaries

_NAMES_SQL = KEYWORDS_SQL + f""",
topic_names AS (
  SELECT t.topic_id, CASE WHEN t.topic_id = -1 THEN '{OUTLIER_NAME}'
    WHEN len(words) > 0 THEN array_to_string(words[1:4], ' ')
    ELSE 'Topic ' || t.topic_id END AS topic_name, words
  FROM (SELECT DISTINCT topic_id FROM given) t
  LEFT JOIN keyword_lists k ON t.topic_id = k.topic_id)
"""


@check("name_topics", f"""
WITH {GIVEN_SQL}, {_NAMES_SQL} SELECT topic_id, topic_name FROM topic_names""")
def name_topics(spark, sf_dir):
    keywords = weights.topic_keywords(fitted(spark, sf_dir))
    return naming.name_topics(given(spark, sf_dir), keywords)


_FIRST_SQL = """
first_rows AS (SELECT * FROM (SELECT topic_id, row_id, review,
  row_number() OVER (PARTITION BY topic_id ORDER BY row_id) AS i FROM given
  WHERE topic_id <> -1) WHERE i <= 3)
"""


@check("topic_prompts", f"""
WITH {GIVEN_SQL}, {_NAMES_SQL}, {_FIRST_SQL},
joined AS (SELECT topic_id, string_agg(i || '. ' || review, chr(10) ORDER BY i) AS samples
  FROM first_rows GROUP BY topic_id)
SELECT j.topic_id,
  'Strongest terms of one group of texts: '
    || array_to_string(words[1:6], ', ') || chr(10) || 'Give this group a short title.'
    AS name_prompt,
  'Group ' || topic_name || ', strongest terms: ' || array_to_string(words[1:6], ', ')
    || chr(10) || 'Some of its texts:' || chr(10) || samples || chr(10)
    || 'In one paragraph, say what these texts share and where they differ.'
    AS summary_prompt
FROM joined j JOIN topic_names n ON j.topic_id = n.topic_id""")
def topic_prompts(spark, sf_dir):
    keywords = materialize(weights.topic_keywords(fitted(spark, sf_dir)), "keywords")
    rows = given(spark, sf_dir)
    return naming.topic_prompts(rows, keywords, naming.name_topics(rows, keywords), "review")


@check("resolve_topic_names", f"""
WITH {GIVEN_SQL}, {_NAMES_SQL}
SELECT topic_id, CASE
  WHEN topic_id = -1 THEN '{OUTLIER_NAME}'
  WHEN topic_id = 4 THEN 'cached name'
  WHEN topic_id % 3 = 0 THEN 'Name of topic ' || topic_id
  WHEN topic_id % 3 = 1 THEN 'Topic ' || topic_id
  ELSE topic_name END AS topic_name
FROM topic_names""")
def resolve_topic_names(spark, sf_dir):
    t = F.col("topic_id")
    words = weights.keyword_lists(weights.topic_keywords(fitted(spark, sf_dir)))
    topics = given(spark, sf_dir).select("topic_id").distinct().join(words, "topic_id", "left")
    replies = topics.select(
        "topic_id", "words",
        F.when(t == 4, "cached name").when(t == 5, "").alias("cached"),
        F.when(t % 3 == 0, F.concat(F.lit("  Name\nof topic "), t.cast("string"), F.lit(" \n")))
        .when(t % 3 == 1, " \n\t").alias("reply"),
    )
    return naming.resolve_names(replies).select("topic_id", "topic_name")


@check("names_to_compute", f"""
WITH {GIVEN_SQL} SELECT DISTINCT topic_id FROM given
WHERE topic_id <> -1 AND topic_id % 2 <> 0""")
def names_to_compute(spark, sf_dir):
    rows = given(spark, sf_dir)
    cache = rows.select("topic_id").distinct().select(
        "topic_id", F.when(F.col("topic_id") % 2 == 0, "known").otherwise("").alias("topic_name")
    )
    return naming.names_to_compute(rows, cache)


@check("extractive_summary", f"""
WITH {GIVEN_SQL}, {WEIGHTS_SQL},
pieces AS (SELECT topic_id, row_id, list_filter(list_transform(
  regexp_split_to_array(review, '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> '') AS s
  FROM given WHERE topic_id <> -1),
sentences AS (SELECT topic_id, row_id, unnest(range(1, len(s) + 1)) AS sentence_no,
  unnest(s) AS sentence FROM pieces),
sprep AS (SELECT * EXCLUDE (p), CASE WHEN p = '' THEN 'emptydoc' ELSE p END AS p FROM (
  SELECT *, regexp_replace(translate(sentence, chr(10) || chr(9), '  '), '[^A-Za-z0-9 ]+', '', 'g')
    AS p FROM sentences)),
swords AS (SELECT * EXCLUDE (p), list_filter(regexp_extract_all(lower(p), '[a-z0-9_]{{2,}}'),
  lambda x: x NOT IN ({STOP_SQL})) AS w FROM sprep),
sterms AS (SELECT topic_id, row_id, sentence_no, sentence, unnest(list_concat(w,
  list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM swords),
scores AS (SELECT s.topic_id, row_id, sentence_no, sentence, sum(weight) AS score
  FROM sterms s JOIN weights w ON s.topic_id = w.topic_id AND s.term = w.term
  GROUP BY 1, 2, 3, 4)
SELECT topic_id, rank, row_id, sentence_no, sentence, round(score, 9) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id
    ORDER BY round(score, 9) DESC, row_id, sentence_no) AS rank FROM scores) WHERE rank <= 3""")
def extractive_summary(spark, sf_dir):
    return naming.extractive_summary(
        given(spark, sf_dir), fitted(spark, sf_dir), "review"
    ).withColumn("score", F.round("score", 9))


@check("topic_details", f"""
WITH {NAMED_SQL}, {KEYWORDS_SQL},
picked AS (SELECT topic_name, count(*) AS n_rows, arg_min(topic_id, row_id) AS topic_id
  FROM named WHERE topic_name IS NOT NULL GROUP BY topic_name
  HAVING bool_or(topic_id <> -1)),
samples AS (SELECT topic_name, review AS sample, sample_no FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_name ORDER BY row_id) AS sample_no FROM named
  WHERE topic_name IS NOT NULL) WHERE sample_no <= 5)
SELECT p.topic_name, p.topic_id, p.n_rows, array_to_string(words, ', ') AS keywords, sample_no,
  sample
FROM picked p JOIN keyword_lists k ON p.topic_id = k.topic_id
JOIN samples s ON p.topic_name = s.topic_name""")
def topic_details(spark, sf_dir):
    rows = named(spark, sf_dir)
    keywords = weights.topic_keywords(fitted(spark, sf_dir))
    return reports.topic_details(rows, keywords, "review")
