import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from topicloom.constants import ENGLISH_STOP_WORDS, NA_TOKENS
from topicloom.functions import numeric, text as T

SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0    　"
LOOSE = settings(max_examples=8, deadline=None,
                 suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("s"))).collect()]


@LOOSE
@given(values=st.lists(
    st.text(alphabet=SPACES + "a​﻿é", max_size=6), min_size=1, max_size=30))
def test_blank_and_strip_follow_unicode_whitespace(spark, values):
    assert column(spark, values, T.is_blank) == [v.strip() == "" for v in values]
    assert column(spark, values, T.strip) == [v.strip() for v in values]


def test_zero_width_characters_are_not_blank(spark):
    values = [" ", " ", "\x1c", "\x85", "​", "﻿", ""]
    assert column(spark, values, T.is_blank) == [True, True, True, True, False, False, True]


NUMBER = re.compile(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*")


@LOOSE
@given(values=st.lists(st.text(alphabet="0123456789.eE+-dfxnNaAi ", max_size=5), min_size=1,
                       max_size=40))
def test_lenient_numbers(spark, values):
    want = [float(v) if NUMBER.fullmatch(v) else None for v in values]
    assert column(spark, values, numeric.coerce_numeric) == want


def test_missing_tokens(spark):
    values = NA_TOKENS + ["na", "nil", "0"]
    assert column(spark, values, T.na_to_null) == [None] * len(NA_TOKENS) + ["na", "nil", "0"]


def test_one_decimal_rounds_half_even(spark):
    df = spark.createDataFrame([(2.25,), (2.35,), (1234.5,)], "x double")
    assert [r[0] for r in df.select(numeric.one_decimal(F.col("x"))).collect()] == [
        "2.2", "2.4", "1234.5"]


def words_of(text, stop):
    found = re.findall(r"\b\w\w+\b", re.sub(r"[^A-Za-z0-9 ]+", "", re.sub(r"[\n\t]", " ", text)).lower())
    return [w for w in found if w not in stop]


def test_words_and_pairs(spark):
    texts = ["The cat's  mat,\nthe DOG a b cd", "", "…", "naïve\tcafé 42 x9", "one"]
    stop = set(ENGLISH_STOP_WORDS)
    got = column(spark, texts, lambda c: T.prepared_words(c, "english", ENGLISH_STOP_WORDS))
    want = [words_of(t, stop) if t not in ("", "…") else ["emptydoc"] for t in texts]
    assert got == want
    pairs = column(spark, texts, lambda c: T.with_bigrams(T.prepared_words(c)))
    for text, terms in zip(texts, pairs):
        w = words_of(text, set()) if text not in ("", "…") else ["emptydoc"]
        assert terms == w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def test_single_line_and_numbered(spark):
    assert column(spark, ["  a\nb\r\nc \n", "\n"], T.single_line) == ["a b c", ""]
    df = spark.createDataFrame([(["x", "y"],)], "a array<string>")
    assert df.select(T.numbered_lines(F.col("a"))).first()[0] == "1. x\n2. y"
