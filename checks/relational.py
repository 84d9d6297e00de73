"""Sources, discovery, filters, joins and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks.registry import (
    GIVEN_SQL, NA_SQL, NAMED_SQL, REVIEWS_SQL, check, embedding_rows, given,
    has_text_sql, named, raw_reviews, sql_list, table,
)
from topicloom.constants import NA_TOKENS
from topicloom.functions.numeric import coerce_numeric
from topicloom.functions.text import has_text, na_to_null, preview
from topicloom.functions.vectors import dot
from topicloom.operators import columns, facets, joins, reports, reuse
from topicloom.operators.projection import reduction_params
from topicloom.scratch import new_path
from topicloom.sources import embeddings as store
from topicloom.sources import tables


def reviews(spark, sf_dir) -> DataFrame:
    return tables.normalize_missing(raw_reviews(spark, sf_dir))


def cleaned(spark, sf_dir) -> DataFrame:
    return facets.clean(reviews(spark, sf_dir), "review")


# Sources and sinks


@check("csv_scan", f"""
SELECT doc_id, CASE WHEN text IN ({NA_SQL}) THEN NULL ELSE text END AS text, lang, source, n_chars
FROM documents""")
def csv_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "documents-csv")
    tables.write_csv(docs, path)
    return tables.read_csv(spark, path, schema=docs.schema)


@check("na_tokens", f"""
SELECT doc_id, raw, CASE WHEN raw IN ({NA_SQL}) THEN NULL ELSE raw END AS value FROM (
  SELECT doc_id, coalesce([{NA_SQL}][CAST(doc_id % 20 AS INT) + 1], source) AS raw
  FROM documents)""")
def na_tokens(spark, sf_dir):
    raw = F.coalesce(
        F.get(F.lit(NA_TOKENS), (F.col("doc_id") % 20).cast("int")), F.col("source")
    )
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).withColumn(
        "value", na_to_null(F.col("raw"))
    )


@check("row_identity", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents""")
def row_identity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return tables.with_parquet_row_id(docs)


@check("embedding_store_roundtrip", """
SELECT vec_id AS row_id, len(embedding) AS dim,
  round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total,
  round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS square
FROM embeddings""")
def embedding_store_roundtrip(spark, sf_dir):
    path = new_path(spark, "embedding-store")
    store.save(
        embedding_rows(spark, sf_dir), path,
        model_name="given", text_column="text", source_columns=5,
    )
    vectors, _ = store.load(spark, path)
    v = F.col("embedding").cast("array<double>")
    return vectors.select(
        "row_id", F.size("embedding").alias("dim"),
        F.round(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"),
        F.round(dot(v, v), 6).alias("square"),
    )


@check("embedding_metadata", """
SELECT 'given' AS model_name, max(len(embedding)) AS embedding_dim, count(*) AS total_samples,
  'text' AS text_column, count(*) AS shape_rows, 5 AS shape_cols
FROM embeddings""")
def embedding_metadata(spark, sf_dir):
    meta = store.metadata(table(spark, sf_dir, "embeddings"), "given", "text", 5)
    return meta.select(
        "model_name", "embedding_dim", "total_samples", "text_column",
        F.col("dataset_shape.rows").alias("shape_rows"),
        F.col("dataset_shape.cols").alias("shape_cols"),
    )


@check("export_results", f"""
WITH {NAMED_SQL} SELECT review AS review_text, topic_id, topic_name FROM named""")
def export_results(spark, sf_dir):
    path = new_path(spark, "export-csv")
    tables.export_csv(named(spark, sf_dir), "review", path)
    return tables.read_csv(
        spark, path, schema="review_text string, topic_id int, topic_name string", normalize=False
    )


@check("data_viewer", f"WITH {REVIEWS_SQL} SELECT * FROM cleaned")
def data_viewer(spark, sf_dir):
    return tables.view(cleaned(spark, sf_dir))


# Schema discovery

_DISCOVERED = [
    ("documents", "text"), ("conversations", "text"), ("benchmark", "text"), ("pages", "html"),
]


@check("find_text_column", " UNION ALL ".join(f"""
SELECT '{t}' AS table_name, '{c}' AS text_column, count(*) AS n_rows,
  count(*) FILTER (WHERE {has_text_sql(c)}) AS n_texts FROM {t}""" for t, c in _DISCOVERED))
def find_text_column(spark, sf_dir):
    out = None
    for name, _ in _DISCOVERED:
        df = table(spark, sf_dir, name)
        column = columns.find_text_column(df)
        one = df.agg(
            F.lit(name).alias("table_name"), F.lit(column).alias("text_column"),
            F.count("*").alias("n_rows"), F.count_if(has_text(F.col(column))).alias("n_texts"),
        )
        out = one if out is None else out.union(one)
    return out


_MEASURED = {
    "pages": [(1, "url"), (2, "html")],
    "documents": [(1, "text"), (2, "lang"), (3, "source")],
    "conversations": [(2, "role"), (3, "text")],
    "customer": [(1, "c_name"), (4, "c_mktsegment")],
}


@check("text_column_by_length", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, "
    f"round(avg(length(coalesce({c}, 'nan'))), 6) AS mean_chars, "
    f"'{c}' = '{longest}' AS longest FROM {t}"
    for (t, cols), longest in zip(_MEASURED.items(), ["html", "text", "text", "c_name"])
    for i, c in cols))
def text_column_by_length(spark, sf_dir):
    out = None
    for name in _MEASURED:
        df = table(spark, sf_dir, name)
        best = columns.longest_text_column(df).select("column").scalar()
        one = columns.mean_text_lengths(df).select(
            F.lit(name).alias("table_name"), "position", F.col("column").alias("column_name"),
            F.round("mean_chars", 6).alias("mean_chars"), (F.col("column") == best).alias("longest"),
        )
        out = one if out is None else out.union(one)
    return out


@check("resolve_facets", f"WITH {REVIEWS_SQL} " + " UNION ALL ".join(f"""
SELECT '{c}' AS facet, '{c}' AS column_name,
  count(*) FILTER (WHERE {has_text_sql(c)}) AS n_values FROM reviews"""
    for c in ["drug", "age", "satisfaction", "gender"]))
def resolve_facets(spark, sf_dir):
    df = reviews(spark, sf_dir)
    found = columns.resolve_facets(df.columns)
    counts = df.agg(*[F.count_if(has_text(F.col(c))).alias(f) for f, c in found.items()])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("facet"), F.lit(c).alias("column_name"), F.col(f).alias("n_values"))
        for f, c in found.items()
    ])).alias("s")).select("s.*")


# Filters and parameters


@check("clean_reviews", f"WITH {REVIEWS_SQL} SELECT row_id, review FROM cleaned")
def clean_reviews(spark, sf_dir):
    return cleaned(spark, sf_dir).select("row_id", "review")


_FILTERS = {"drug": ["src1", "src2", "src3"], "gender": ["0"], "age": [], "absent": ["x"]}


@check("facet_filter", f"""
WITH {REVIEWS_SQL} SELECT row_id, drug, age, gender FROM cleaned
WHERE drug IN ({sql_list(_FILTERS['drug'])}) AND gender IN ('0')""")
def facet_filter(spark, sf_dir):
    return facets.facet_filter(cleaned(spark, sf_dir), _FILTERS).select(
        "row_id", "drug", "age", "gender"
    )


@check("facet_all", f"""
WITH {REVIEWS_SQL} SELECT row_id, drug FROM cleaned WHERE {has_text_sql('drug')}""")
def facet_all(spark, sf_dir):
    return facets.facet_all(cleaned(spark, sf_dir), "drug").select("row_id", "drug")


@check("refine_multiselect", f"""
WITH {REVIEWS_SQL} SELECT row_id, age FROM cleaned WHERE age IN ('en', 'fr')""")
def refine_multiselect(spark, sf_dir):
    return facets.refine_multiselect(cleaned(spark, sf_dir), "age", ["en", "fr"]).select(
        "row_id", "age"
    )


_NUMBERS = ["5d", "NaN", " 3.5 ", "1e3", "inf", ".5", "-7.", "abc", "+2", "1_0", "0x1", "5f"]
_NUMBER_SQL = r"regexp_full_match(raw, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')"


@check("coerce_numeric", f"""
SELECT doc_id, raw, CASE WHEN {_NUMBER_SQL} THEN TRY_CAST(trim(raw) AS DOUBLE) END AS number
FROM (SELECT doc_id, coalesce([{sql_list(_NUMBERS)}][CAST(doc_id % 16 AS INT) + 1],
  CAST(n_chars AS VARCHAR)) AS raw FROM documents)""")
def coerce_numbers(spark, sf_dir):
    raw = F.coalesce(
        F.get(F.lit(_NUMBERS), (F.col("doc_id") % 16).cast("int")), F.col("n_chars").cast("string")
    )
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).withColumn(
        "number", coerce_numeric(F.col("raw"))
    )


_BOUNDS_SQL = """
numbers AS (SELECT * REPLACE (TRY_CAST(satisfaction AS DOUBLE) AS satisfaction) FROM {0}),
bounds AS (SELECT min(satisfaction) AS min_value, max(satisfaction) AS max_value,
  CAST(trunc(min(satisfaction)) AS BIGINT) AS lower_bound,
  CAST(trunc(max(satisfaction)) AS BIGINT) AS upper_bound FROM numbers)
"""


@check("numeric_bounds", f"""
WITH {REVIEWS_SQL}, {_BOUNDS_SQL.format('cleaned')} SELECT * FROM bounds""")
def numeric_bounds(spark, sf_dir):
    return facets.numeric_bounds(cleaned(spark, sf_dir), "satisfaction")


@check("refine_range", f"""
WITH {REVIEWS_SQL}, {_BOUNDS_SQL.format('cleaned')}
SELECT row_id, satisfaction FROM numbers, bounds
WHERE satisfaction BETWEEN lower_bound AND upper_bound""")
def refine_range(spark, sf_dir):
    return facets.refine_range(cleaned(spark, sf_dir), "satisfaction").select(
        "row_id", "satisfaction"
    )


@check("refine_single", f"""
WITH {REVIEWS_SQL} SELECT row_id, gender FROM cleaned WHERE gender = '1'""")
def refine_single(spark, sf_dir):
    return facets.refine_single(cleaned(spark, sf_dir), "gender", "1").select("row_id", "gender")


@check("refine_cascade", f"""
WITH {REVIEWS_SQL}, aged AS (SELECT * FROM cleaned WHERE age IN ('en', 'fr')),
{_BOUNDS_SQL.format('aged')}
SELECT row_id, age, satisfaction, gender FROM numbers, bounds
WHERE satisfaction BETWEEN lower_bound AND upper_bound AND gender = '0'""")
def refine_cascade(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    found = columns.resolve_facets(df.columns)
    return facets.refine(df, found, ages=["en", "fr"], gender="0").select(
        "row_id", "age", "satisfaction", "gender"
    )


@check("drop_outliers", f"""
WITH {GIVEN_SQL} SELECT row_id, topic_id FROM given WHERE topic_id <> -1""")
def drop_outliers(spark, sf_dir):
    return reports.drop_outliers(given(spark, sf_dir)).select("row_id", "topic_id")


@check("text_preview", """
SELECT doc_id, substring(text, 1, 100) || '...' AS preview FROM documents""")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@check("size_gate", f"""
WITH {REVIEWS_SQL} SELECT count(*) AS n_rows, count(e.vec_id) AS n_embeddings,
  CASE WHEN count(e.vec_id) < 10 THEN 'too_small' ELSE 'ok' END AS status
FROM cleaned c LEFT JOIN embeddings e ON c.row_id = e.vec_id""")
def size_gate(spark, sf_dir):
    return facets.size_gate(cleaned(spark, sf_dir), embedding_rows(spark, sf_dir))


@check("adaptive_params", f"""
WITH {REVIEWS_SQL}
SELECT drug, age, n,
  CASE WHEN n < 50 THEN least(3, n // 5) ELSE 5 END AS n_topics,
  CASE WHEN n < 50 THEN greatest(2, n // 10) ELSE 10 END AS min_topic_size
FROM (SELECT drug, age, count(*) AS n FROM cleaned GROUP BY drug, age)""")
def adaptive_params(spark, sf_dir):
    counts = cleaned(spark, sf_dir).groupBy("drug", "age").agg(F.count("*").alias("n"))
    return facets.adaptive_params(counts)


@check("reduction_params", f"""
WITH {REVIEWS_SQL}
SELECT drug, age, gender, n, components,
  CASE WHEN n < components + 1 THEN 'pca' ELSE 'neighbors' END AS method,
  CASE WHEN n < components + 1 THEN least(components, n - 1) ELSE components END AS k,
  CASE WHEN n >= components + 1 THEN least(15, greatest(2, n // 3)) END AS n_neighbors,
  CASE WHEN n >= components + 1 THEN CASE WHEN n > 50 THEN 0.1 ELSE 0.01 END END::DOUBLE
    AS min_dist
FROM (SELECT drug, age, gender, count(*) AS n FROM cleaned GROUP BY drug, age, gender),
  (SELECT unnest([2, 3]) AS components)""")
def reduction_rules(spark, sf_dir):
    counts = cleaned(spark, sf_dir).groupBy("drug", "age", "gender").agg(F.count("*").alias("n"))
    return counts.withColumn("components", F.explode(F.array(F.lit(2), F.lit(3)))).select(
        "*", *reduction_params(F.col("n"), F.col("components"))
    )


# Joins


@check("join_embeddings", f"""
WITH {REVIEWS_SQL}
SELECT row_id, age, len(embedding) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
FROM cleaned JOIN embeddings ON row_id = vec_id""")
def join_embeddings(spark, sf_dir):
    joined = joins.join_embeddings(cleaned(spark, sf_dir), embedding_rows(spark, sf_dir))
    v = F.col("embedding").cast("array<double>")
    return joined.select(
        "row_id", "age", F.size("embedding").alias("dim"),
        F.round(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"),
    )


@check("embedding_orphans", """
SELECT doc_id AS row_id, 'no_embedding' AS side FROM documents
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL
SELECT vec_id, 'no_row' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def embedding_orphans(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    return joins.orphans(rows, embedding_rows(spark, sf_dir))


@check("refine_topics_semi", f"""
WITH {REVIEWS_SQL}, {GIVEN_SQL}
SELECT row_id, topic_id FROM given
WHERE row_id IN (SELECT row_id FROM cleaned WHERE age IN ('en', 'de'))""")
def refine_topics_semi(spark, sf_dir):
    refined = facets.refine_multiselect(cleaned(spark, sf_dir), "age", ["en", "de"])
    return joins.keep_refined(given(spark, sf_dir), refined).select("row_id", "topic_id")


@check("map_topic_names", f"WITH {NAMED_SQL} SELECT row_id, topic_id, topic_name FROM named")
def map_topic_names(spark, sf_dir):
    return named(spark, sf_dir).select("row_id", "topic_id", "topic_name")


@check("topic_id_by_name", f"""
WITH {NAMED_SQL} SELECT topic_name, arg_min(topic_id, row_id) AS topic_id FROM named
WHERE topic_name IS NOT NULL GROUP BY topic_name""")
def topic_id_by_name(spark, sf_dir):
    return joins.topic_id_by_name(named(spark, sf_dir))


# Aggregations, windows and reports


@check("filter_funnel", f"""
WITH {REVIEWS_SQL}
SELECT count(*) AS total, count(review) AS present,
  count(*) FILTER (WHERE {has_text_sql('review')}) AS not_blank,
  count(*) FILTER (WHERE {has_text_sql('review')} AND {has_text_sql('drug')}) AS with_drug,
  count(*) FILTER (WHERE {has_text_sql('review')} AND {has_text_sql('drug')} AND age = 'en')
    AS refined
FROM reviews""")
def filter_funnel(spark, sf_dir):
    return facets.funnel(reviews(spark, sf_dir), {
        "present": F.col("review").isNotNull(),
        "not_blank": has_text(F.col("review")),
        "with_drug": has_text(F.col("drug")),
        "refined": F.col("age") == "en",
    })


@check("facet_options", f"""
WITH {REVIEWS_SQL} SELECT DISTINCT drug FROM cleaned WHERE {has_text_sql('drug')} ORDER BY drug""")
def facet_options(spark, sf_dir):
    return facets.facet_options(cleaned(spark, sf_dir), "drug")


_DISTRIBUTION_SQL = NAMED_SQL + """,
distribution AS (SELECT topic_name, count(*) AS n_rows FROM named
  WHERE topic_id <> -1 AND topic_name IS NOT NULL GROUP BY topic_name)
"""


@check("topic_distribution", f"""
WITH {_DISTRIBUTION_SQL} SELECT * FROM distribution ORDER BY n_rows DESC, topic_name""")
def topic_distribution(spark, sf_dir):
    return reports.topic_distribution(named(spark, sf_dir))


@check("topic_distribution_by_id", f"""
WITH {GIVEN_SQL} SELECT topic_id, count(*) AS n_rows FROM given WHERE topic_id <> -1
GROUP BY topic_id ORDER BY n_rows DESC, topic_id""")
def topic_distribution_by_id(spark, sf_dir):
    return reports.topic_distribution(given(spark, sf_dir), by="topic_id")


@check("topic_share", f"""
WITH {_DISTRIBUTION_SQL}
SELECT topic_name, n_rows, round(n_rows / (SELECT sum(n_rows) FROM distribution), 9) AS share
FROM distribution""")
def topic_share(spark, sf_dir):
    return reports.topic_share(named(spark, sf_dir)).withColumn("share", F.round("share", 9))


@check("topic_ids", f"""
WITH {GIVEN_SQL} SELECT DISTINCT topic_id FROM given WHERE topic_id <> -1 ORDER BY topic_id""")
def topic_ids(spark, sf_dir):
    return reports.topic_ids(given(spark, sf_dir))


@check("summary_stats", f"""
WITH {_DISTRIBUTION_SQL},
stats AS (SELECT count(*) AS total_rows,
  count(DISTINCT topic_id) FILTER (WHERE topic_id <> -1) AS topics_found,
  count(*) FILTER (WHERE topic_id <> -1) AS valid FROM named)
SELECT total_rows, topics_found, round(valid / topics_found, 9) AS mean_rows_per_topic,
  format('{{:.1f}}', valid / topics_found) AS mean_rows_text,
  (SELECT CAST(max(n_rows) AS BIGINT) FROM distribution) AS largest_topic_rows
FROM stats""")
def summary_stats(spark, sf_dir):
    return reports.summary_stats(named(spark, sf_dir)).withColumn(
        "mean_rows_per_topic", F.round("mean_rows_per_topic", 9)
    )


@check("legend_order", f"""
WITH {NAMED_SQL} SELECT topic_name, min(row_id) AS first_row FROM named WHERE topic_id <> -1
GROUP BY topic_name ORDER BY first_row""")
def legend_order(spark, sf_dir):
    return reports.legend_order(named(spark, sf_dir))


SAMPLES_SQL = NAMED_SQL + """,
samples AS (SELECT topic_name, row_id, review AS sample, sample_no FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_name ORDER BY row_id) AS sample_no FROM named
  WHERE topic_name IS NOT NULL) WHERE sample_no <= 5)
"""


@check("topic_samples", f"WITH {SAMPLES_SQL} SELECT * FROM samples")
def topic_samples(spark, sf_dir):
    return reports.topic_samples(named(spark, sf_dir), "review")


# Reuse


@check("filter_fingerprint", """
SELECT lang, sha256(to_json([
    {'key': 'age', 'values': [lang]},
    {'key': 'drug', 'values': list_sort(list(DISTINCT source))}])::VARCHAR) AS fingerprint
FROM documents GROUP BY lang""")
def filter_fingerprint(spark, sf_dir):
    chosen = table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.collect_set("source").alias("sources")
    )
    return chosen.select("lang", reuse.fingerprint(F.create_map(
        F.lit("drug"), F.col("sources"), F.lit("age"), F.array("lang")
    )).alias("fingerprint"))
