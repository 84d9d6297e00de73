"""Every registered query with SQL must match it on the smallest tables."""

import pytest

import __spark_entry__ as entry
import verify

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    good, note = verify.compare(spark, con, name, SF_DIR)
    assert good, note


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_names_every_topic(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["topic_name"] and r["n_rows"] > 0 for r in rows)


def test_topic_model_invariants(spark):
    rows = entry.queries()["topic_model"](spark, SF_DIR).collect()
    assert len({r["row_id"] for r in rows}) == len(rows) == 200
    sizes = {}
    for r in rows:
        sizes[r["topic_id"]] = sizes.get(r["topic_id"], 0) + 1
    topics = sorted(t for t in sizes if t != -1)
    assert topics == list(range(len(topics))) and len(topics) <= 5
    assert [sizes[t] for t in topics] == sorted((sizes[t] for t in topics), reverse=True)
    assert all(sizes[t] >= 10 for t in topics)
