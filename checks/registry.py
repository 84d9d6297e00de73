"""Registration of queries and the input tables they share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from topicloom.constants import ENGLISH_STOP_WORDS, NA_TOKENS, OUTLIER_NAME
from topicloom.operators.joins import map_topic_names

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query and, where SQL can state the result, its SQL."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


BLANK = r"regexp_full_match({0}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]*')"
HAS_TEXT = "({0} IS NOT NULL AND NOT " + BLANK + ")"
NA_SQL = sql_list(NA_TOKENS)
STOP_SQL = sql_list(ENGLISH_STOP_WORDS)


def has_text_sql(column: str) -> str:
    return HAS_TEXT.format(column)


# Reviews: documents with blanks, missing tokens, missing facets and bad numbers.

REVIEWS_SQL = f"""
raw_reviews AS (
  SELECT d.doc_id AS row_id,
    CASE WHEN d.doc_id % 50 = 0 THEN ' ' || chr(9) WHEN d.doc_id % 50 = 1 THEN 'N/A'
         ELSE d.text END AS review,
    CASE WHEN d.doc_id % 13 = 0 THEN NULL WHEN d.doc_id % 13 = 1 THEN ' '
         ELSE d.source END AS drug,
    d.lang AS age,
    CASE WHEN d.doc_id % 7 = 6 THEN 'n/a' ELSE CAST(d.doc_id % 7 AS VARCHAR) || '.5' END
      AS satisfaction,
    CAST(l.toxic AS VARCHAR) AS gender
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
reviews AS (
  SELECT row_id, CASE WHEN review IN ({NA_SQL}) THEN NULL ELSE review END AS review,
    drug, age, CASE WHEN satisfaction IN ({NA_SQL}) THEN NULL ELSE satisfaction END
      AS satisfaction, gender
  FROM raw_reviews),
cleaned AS (SELECT * FROM reviews WHERE {has_text_sql('review')})
"""


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    i = F.col("doc_id")
    return d.join(labels, "doc_id", "left").select(
        i.alias("row_id"),
        F.when(i % 50 == 0, " \t").when(i % 50 == 1, "N/A").otherwise(F.col("text"))
        .alias("review"),
        F.when(i % 13 == 0, None).when(i % 13 == 1, " ").otherwise(F.col("source")).alias("drug"),
        F.col("lang").alias("age"),
        F.when(i % 7 == 6, "n/a").otherwise(F.concat((i % 7).cast("string"), F.lit(".5")))
        .alias("satisfaction"),
        F.col("toxic").cast("string").alias("gender"),
    )


# Given topics: all documents, with the label of their embedding as topic, else a digit of the
# id; 0 means outlier. Queries on vectors keep the rows that have one.

GIVEN_SQL = """
given AS (
  SELECT d.doc_id AS row_id, d.text AS review, d.lang AS age,
    coalesce(e.label, d.doc_id % 10) - 1 AS topic_id, e.embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)
"""

NAMED_SQL = GIVEN_SQL + f""",
names AS (
  SELECT DISTINCT topic_id, CASE topic_id WHEN -1 THEN '{OUTLIER_NAME}' WHEN 8 THEN 'theme 3'
    ELSE 'theme ' || topic_id END AS topic_name
  FROM given WHERE topic_id <> 7),
named AS (SELECT g.*, n.topic_name FROM given g LEFT JOIN names n ON g.topic_id = n.topic_id)
"""


def given(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "label", "embedding"
    )
    topic = F.coalesce("label", F.col("doc_id") % 10) - 1
    return table(spark, sf_dir, "documents").join(e, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("review"),
        F.col("lang").alias("age"), topic.alias("topic_id"), "embedding",
    )


def given_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("topic_id")
    return given(spark, sf_dir).select("topic_id").distinct().filter(t != 7).select(
        "topic_id",
        F.when(t == -1, OUTLIER_NAME).when(t == 8, "theme 3")
        .otherwise(F.concat(F.lit("theme "), t.cast("string"))).alias("topic_name"),
    )


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_topic_names(given(spark, sf_dir), given_names(spark, sf_dir))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")


# Terms and weights of the given topics.

COUNTS_SQL = f"""
prepared AS (
  SELECT row_id, topic_id, CASE WHEN p = '' THEN 'emptydoc' ELSE p END AS p FROM (
    SELECT row_id, topic_id, regexp_replace(translate(review, chr(10) || chr(9), '  '),
      '[^A-Za-z0-9 ]+', '', 'g') AS p FROM given)),
words AS (
  SELECT row_id, topic_id, list_filter(regexp_extract_all(lower(p), '[a-z0-9_]{{2,}}'),
    lambda x: x NOT IN ({STOP_SQL})) AS w FROM prepared),
terms AS (
  SELECT row_id, topic_id, unnest(list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
counts AS (SELECT topic_id, term, count(*) AS n FROM terms GROUP BY topic_id, term)
"""

WEIGHTS_SQL = COUNTS_SQL + """,
totals AS (SELECT topic_id, sum(n) AS topic_terms FROM counts GROUP BY topic_id),
corpus AS (SELECT term, sum(n) AS f FROM counts GROUP BY term),
weights AS (
  SELECT c.topic_id, c.term, c.n,
    ln(1 + (SELECT floor(avg(topic_terms)) FROM totals) / f) AS idf,
    c.n / topic_terms * ln(1 + (SELECT floor(avg(topic_terms)) FROM totals) / f) AS weight
  FROM counts c JOIN totals t ON c.topic_id = t.topic_id JOIN corpus k ON c.term = k.term)
"""

KEYWORDS_SQL = WEIGHTS_SQL + """,
keywords AS (
  SELECT topic_id, term, weight, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 12) DESC, term)
      AS rank FROM weights) WHERE rank <= 10),
keyword_lists AS (
  SELECT topic_id, list(term ORDER BY rank) AS words FROM keywords GROUP BY topic_id)
"""
