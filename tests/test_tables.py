import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.constants import NA_TOKENS
from topicloom.operators import columns, facets, joins, naming, reports, reuse, weights
from topicloom.operators.embed import encode_with, hashed_tfidf
from topicloom.operators.projection import reduce_dimensions, reduction_params
from topicloom.plans.embedding_job import build_store
from topicloom.plans import reused
from topicloom.plans.topic_model import TooFewRows, TopicParams, fit
from topicloom.sources import embeddings, tables


def test_csv_keeps_quotes_line_breaks_and_missing(spark, tmp_path):
    path = tmp_path / "in.csv"
    body = 'id,Review,drug\n1,"two\nlines ""quoted"", x",a\n2," padded ",\n3,"",b\n'
    body += "".join(f'{i + 10},"{t}",c\n' for i, t in enumerate(NA_TOKENS))
    path.write_text(body)
    df = tables.read_csv(spark, str(path))
    got = {r["id"]: (r["Review"], r["drug"]) for r in df.collect()}
    assert got["1"] == ('two\nlines "quoted", x', "a")
    assert got["2"] == (" padded ", None)
    assert got["3"] == (None, "b")
    assert all(got[str(i + 10)] == (None, "c") for i in range(len(NA_TOKENS)))
    with pytest.raises(tables.SourceError, match="not found"):
        tables.read_csv(spark, str(tmp_path / "none.csv"))


def test_csv_names_cells_that_do_not_fit_the_schema(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,score,day,text\n1, 2.5 ,2024-02-29,a\nx,N/A,2024-02-30,"b\nc"\n,two,,\n3,4\n')
    schema = "id int, score double, day date, text string"
    rows = tables.read_csv(spark, str(path), schema, bad_cells="bad").collect()
    assert [r["bad"] for r in rows] == [[], ["id", "day"], ["score"], []]
    assert [(r["id"], r["score"], str(r["day"]), r["text"]) for r in rows] == [
        (1, 2.5, "2024-02-29", "a"), (None, None, "None", "b\nc"), (None, None, "None", None), (3, 4.0, "None", None)]
    with pytest.raises(ValueError, match="schema"):
        tables.read_csv(spark, str(path), bad_cells="bad")
    flat = tmp_path / "flat.csv"
    flat.write_text("id\n" + "".join(f"{i}\n" for i in range(2000)))
    parts = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
        split = tables.read_csv(spark, str(flat), "id int", line_breaks=False)
        assert split.select(F.spark_partition_id()).distinct().count() > 1
        assert split.agg(F.sum("id")).first()[0] == 1999 * 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", parts)


def test_row_ids_follow_files_and_lines(spark, tmp_path):
    want = []
    for f in range(3):
        lines = [f"{f}-{i}" for i in range(4 + f)]
        (tmp_path / f"part-{f}.csv").write_text("name\n" + "".join(x + "\n" for x in lines))
        want += lines
    df = tables.with_row_id(tables.read_csv(spark, str(tmp_path), normalize=False))
    assert [r["name"] for r in df.orderBy("row_id").collect()] == want
    assert [r["row_id"] for r in df.orderBy("row_id").collect()] == list(range(len(want)))


def test_text_column_discovery(spark):
    assert columns.text_column_by_name(["id", "Comment", "review"]) == "Comment"
    assert columns.text_column_by_name(["id", "review", "Comment"]) == "review"
    df = spark.createDataFrame(
        [("aa", None, "bb", 1), ("aaaa", None, None, 2)],
        "a string, empty string, b string, n int")
    assert columns.find_text_column(df) == "a"
    tie = spark.createDataFrame([("xxx", None), ("xxx", "zzz")], "p string, q string")
    assert columns.find_text_column(tie) == "p"
    assert columns.find_text_column(spark.range(2)) is None
    assert columns.find_text_column(df, "b") == "b"
    found = columns.resolve_facets(["gender", "Sex", "drugName", "Drug"])
    assert found == {"drug": "Drug", "age": None, "satisfaction": None, "gender": "gender"}


def test_all_choice_and_ranges(spark):
    df = spark.createDataFrame(
        [(1, "a", "1.5"), (2, None, "4.7"), (3, " ", "x"), (4, "b", "4")],
        "row_id long, drug string, sat string")
    assert {r["row_id"] for r in facets.facet_all(df, "drug").collect()} == {1, 4}
    blank = df.withColumn("drug", F.lit(" "))
    assert facets.facet_all(blank, "drug").count() == 4
    assert {r["row_id"] for r in facets.refine_range(df, "sat").collect()} == {1, 4}
    exact = facets.refine_range(df, "sat", bounds="exact")
    assert {r["row_id"] for r in exact.collect()} == {1, 2, 4}
    none = facets.refine_range(df.withColumn("sat", F.lit("n/a")), "sat")
    assert none.count() == 4
    assert facets.refine_single(df, "drug", "All").count() == 4
    many = facets.facet_filter(df, {"row_id": list(range(2, 2000))})
    assert {r["row_id"] for r in many.collect()} == {2, 3, 4}
    with pytest.raises(ValueError):
        facets.require_selection([])


def test_size_rules(spark):
    ns = [0, 1, 2, 3, 4, 9, 10, 14, 15, 49, 50, 51, 200]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    for r in facets.adaptive_params(df).collect():
        n = r["n"]
        assert r["n_topics"] == (min(3, n // 5) if n < 50 else 5)
        assert r["min_topic_size"] == (max(2, n // 10) if n < 50 else 10)
    for comps in (2, 3):
        for r in df.select("n", *reduction_params(F.col("n"), F.lit(comps))).collect():
            n = r["n"]
            if n < comps + 1:
                assert (r["method"], r["k"]) == ("pca", min(comps, n - 1))
            else:
                assert r["n_neighbors"] == min(15, max(2, n // 3))
                assert r["min_dist"] == (0.1 if n > 50 else 0.01)


def test_reports_without_topics(spark):
    df = spark.createDataFrame(
        [(1, -1, "Outliers/Miscellaneous"), (2, -1, "Outliers/Miscellaneous")],
        "row_id long, topic_id int, topic_name string")
    assert tuple(reports.summary_stats(df).first()) == (2, 0, 0.0, "0", 0)
    assert reports.topic_distribution(df).count() == 0
    empty = df.filter("row_id < 0")
    assert tuple(reports.summary_stats(empty).first()) == (0, 0, 0.0, "0", 0)


def test_names(spark):
    ids = spark.createDataFrame([(-1,), (0,), (1,), (2,)], "topic_id int")
    words = spark.createDataFrame(
        [(-1, 1, "z", 1.0)] + [(0, i + 1, w, 1.0) for i, w in enumerate("abcde")]
        + [(1, 1, "solo", 1.0)], "topic_id int, rank int, term string, weight double")
    names = {r[0]: r[1] for r in naming.name_topics(ids, words).collect()}
    assert names == {-1: "Outliers/Miscellaneous", 0: "a b c d", 1: "solo", 2: "Topic 2"}
    same = spark.createDataFrame(
        [(5, 1, "n"), (3, 2, "n"), (9, 1, "n")], "row_id long, topic_id int, topic_name string")
    assert joins.topic_id_by_name(same).first()["topic_id"] == 2


def test_fingerprint_ignores_order_and_reuse_runs_once(spark, tmp_path):
    one = reuse.fingerprint_of(spark, {"drug": ["b", "a"], "age": []}, {"k": 5})
    assert one == reuse.fingerprint_of(spark, {"drug": ["a", "b"]}, {"k": 5})
    assert one != reuse.fingerprint_of(spark, {"drug": ["a", "b"]}, {"k": 6})
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert reuse.reuse(spark, str(tmp_path), one, compute).count() == 3
    assert len(calls) == 1


def test_embedding_job_and_store(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "good pills"), (2, " "), (3, None), (4, "bad pills pills")],
        "row_id long, review string")
    assert build_store(df, str(tmp_path / "s")) == "review"
    vectors, meta = embeddings.load(spark, str(tmp_path / "s"))
    assert {r["row_id"] for r in vectors.collect()} == {1, 4}
    assert meta.first()["total_samples"] == 2 and meta.first()["embedding_dim"] == 512
    with pytest.warns(UserWarning, match="no embeddings"):
        assert embeddings.load(spark, str(tmp_path / "nothing")) is None
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>")
    with pytest.raises(Exception, match="differ in width"):
        embeddings.metadata(mixed, "m", "t", 1).collect()


def test_hashed_tfidf_matches_hand_computation(spark):
    from pyspark.ml.feature import HashingTF
    import math

    texts = ["red red blue", "blue green", "red"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, review string")
    got = {r["row_id"]: r["features"].toArray() for r in hashed_tfidf(df, "review").collect()}
    index = HashingTF(numFeatures=512).indexOf
    freq = {w: sum(w in t.split() for t in texts) for w in "red blue green".split()}
    for i, t in enumerate(texts):
        want = [0.0] * 512
        for w in t.split():
            want[index(w)] += math.log(4 / (freq[w] + 1))
        length = math.sqrt(sum(x * x for x in want)) or 1.0
        assert all(abs(a - b / length) < 1e-9 for a, b in zip(got[i], want))


def test_user_encoder(spark):
    def make():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype="float32")

    df = spark.createDataFrame([(1, "abc"), (2, "z")], "row_id long, review string")
    got = {r[0]: r[1] for r in encode_with(df, "review", make).collect()}
    assert got == {1: [3.0, 1.0], 2: [1.0, 1.0]}


def test_projection_matches_svd(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(30, 6)) * np.arange(1, 7) + 3
    df = spark.createDataFrame(
        [(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, v array<double>")
    got = np.array([r["reduced"] for r in reduce_dimensions(df, "v", 3).orderBy("row_id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (u * s)[:, :3]
    top = np.abs(vt[:3]).argmax(1)
    want = want * np.sign(vt[np.arange(3), top])
    assert np.allclose(got, want, atol=1e-6)
    two = reduce_dimensions(df.limit(2), "v", 3).collect()
    assert all(r["reduced"][1:] == [0.0, 0.0] for r in two)


def test_too_few_rows(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "row_id long, review string")
    with pytest.raises(TooFewRows):
        fit(df, "review")


def test_facet_values_are_cast_alike_for_any_number(spark):
    from topicloom.operators.facets import facet_filter

    rows = spark.createDataFrame([("1",), ("n/a",), ("7",), (None,)], "grade string")
    few = facet_filter(rows, {"grade": [1]}).collect()
    many = facet_filter(rows, {"grade": [1, *range(100, 1500)]}).collect()
    assert few == many and [r["grade"] for r in few] == ["1"]
    numbers = spark.createDataFrame([(1,), (2,)], "age int")
    assert facet_filter(numbers, {"age": ["x", "2"]}).count() == 1


def test_replies_of_a_model_that_fails_and_one_that_answers(spark):
    ids = spark.createDataFrame([(-1,), (0,), (1,), (2,), (3,), (3,)], "topic_id int")
    keywords = spark.createDataFrame(
        [(t, r, f"w{t}{r}", 1.0) for t in range(4) for r in (1, 2)], "topic_id int, rank int, term string, weight double"
    )
    prompts = spark.createDataFrame(
        [(0, "ask 0"), (1, "bad 1"), (2, None), (3, "known 3")], "topic_id int, name_prompt string"
    ).coalesce(1)
    cache = spark.createDataFrame([(3, "cached"), (2, "")], "topic_id int, topic_name string")

    def answering():
        def client(asked):
            if any(p.startswith(("bad", "known")) for p in asked):
                raise RuntimeError("no answer")
            return [f" Title\nof {p} " for p in asked]
        return client

    def failing():
        def client(asked):
            raise RuntimeError("down")
        return client

    def short():
        return lambda asked: ["one"] * (len(asked) - 1)

    def names(client):
        found = naming.names_by_model(ids, keywords, prompts, cache, client).collect()
        assert len(found) == 5
        return dict(map(tuple, found))

    plain = dict(map(tuple, naming.name_topics(ids, keywords).collect()))
    assert names(failing) == names(short) == plain | {3: "cached"}
    assert names(answering) == plain | {0: "Title of ask 0", 3: "cached"}


def test_summary_rows_do_not_depend_on_heavy_terms(spark):
    import random

    rnd = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    rows = [
        (i, i % 3, ". ".join(" ".join(rnd.choices(words, k=rnd.randint(1, 12))) for _ in range(rnd.randint(0, 6))))
        for i in range(90)
    ]
    rows += [(200, 3, "orange peel. and that"), (201, 4, None), (202, -1, "left out")]
    topics = spark.createDataFrame(rows, "row_id long, topic_id int, body string")
    w = spark.createDataFrame(
        [(t, word, rnd.random() ** 4) for t in range(4) for word in words] + [(3, "orange", 0.5)],
        "topic_id int, term string, weight double",
    )
    found = [
        sorted((r["topic_id"], r["rank"], r["row_id"], r["sentence_no"], round(r["score"], 9)) for r in
               naming.extractive_summary(topics, w, "body", heavy_terms=n).collect())
        for n in (0, 5, 1000)
    ]
    assert found[0] == found[1] == found[2] and len(found[0]) == 10


def test_fit_and_names_are_reused_until_a_file_changes(spark, tmp_path, monkeypatch):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    texts = ["red apple pie", "blue whale song"]
    rows = spark.createDataFrame([(i, texts[i % 2] + f" number{i % 5}") for i in range(60)], "row_id long, body string")
    rows.coalesce(1).write.parquet(source)
    fits, fitted = [], reused.fit
    monkeypatch.setattr(reused, "fit", lambda *a: fits.append(1) or fitted(*a))
    params = TopicParams(method="kmeans", n_topics=2, min_topic_size=5, min_rows=5, first_clusters=2)

    def run(**other):
        return reused.fit_once(spark.read.parquet(source), "body", store, [source], params=params, **other)

    model, folder = run()
    again, same = run()
    assert same == folder and len(fits) == 1
    assert sorted(map(tuple, again.names.collect())) == sorted(map(tuple, model.names.collect()))
    client = lambda: lambda asked: ["A title"] * len(asked)
    broken = lambda: lambda asked: 1 / 0
    names = reused.names_once(model, folder, "body", "m", client)
    assert {r["topic_name"] for r in names.filter("topic_id >= 0").collect()} == {"A title"}
    kept = reused.names_once(again, same, "body", "m", broken)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, names.collect()))
    assert run(filters={"drug": ["A"]})[1] != folder and len(fits) == 2
    rows.limit(50).coalesce(1).write.mode("append").parquet(source)
    changed, other = run()
    assert other != folder and len(fits) == 3 and changed.topics.count() > model.topics.count()


def test_term_counts_of_english_texts_match_the_word_expressions(spark, monkeypatch):
    texts = [
        "Don't stop\tthe quick-brown\nfox, the FOX runs", "", None, "a b c", "\u00e9t\u00e9 \u4e2d\u6587 caf\u00e9 42 .", "fox runs " * 40,
        "emptydoc x", "\x0bfox\r\nruns", "!!! ???", "the", "one two the a three",
    ]
    rows = spark.createDataFrame(
        [(t, x) for t in (3, -1, None) for x in texts], "topic_id int, review string"
    ).repartition(3)
    expected = weights.with_terms(rows, "review").select("topic_id", F.explode("terms").alias("term"))
    expected = sorted(map(str, expected.groupBy("topic_id", "term").agg(F.count("*").alias("n")).collect()))
    for size in (1, 60, 1 << 20):
        monkeypatch.setattr(weights, "COUNTED_BYTES", size)
        found = weights.class_term_counts(rows, "review")
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, found.collect())) == expected


def test_other_languages_read_the_texts_once(spark):
    rows = spark.createDataFrame([(1, "der Baum und der Hund"), (2, "der Hund")], "topic_id int, review string")
    found = weights.class_term_counts(rows, "review", "german", ())
    spread = found.select("topic_id", "term", "n")
    spread.collect()
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_keywords_are_found_among_few_terms_a_topic(spark):
    rng = np.random.default_rng(3)
    rows = [(t, f"w{i}", float(w)) for t in (0, 1) for i, w in enumerate(rng.integers(1, 40, 900) / 64)]
    rows += [(2, "one", 0.5), (2, "two", 0.25), (None, "none", 0.1)]
    table = spark.createDataFrame(rows, "topic_id int, term string, weight double")
    found = {(r["topic_id"], r["rank"]): r["term"] for r in weights.topic_keywords(table, 7).collect()}
    expected = {}
    for t in (0, 1, 2, None):
        mine = sorted((-w, term) for topic, term, w in rows if topic == t)[:7]
        expected |= {(t, i + 1): term for i, (_, term) in enumerate(mine)}
    assert found == expected
