"""Judge URLs by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with its literal tokens. Each rule is
filed under the one of its tokens that the fewest URLs hold; the tokens of a URL fetch
candidate rules, and only these run their expression. The longest rule that fits wins, a
block before an allow of equal length. Without a fit the method's verdict is ``default``.

Cases: a null URL or one without ``://`` has an empty host and path; repeated pages are judged
alike and each returned; an empty table gives no rows; no rules leave the default verdict;
extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicloom.scratch import materialize

TOKEN = "[a-z0-9]+"
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    """A verdict for hosts under ``host`` whose path begins with ``path``."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, name: str) -> Rule:
    """``example.net/en/`` fits example.net and its subdomains at paths under /en/."""
    host, _, path = name.partition("/")
    # Only whole tokens count: the end of a path rule may be inside a longer word.
    whole = re.findall(TOKEN, host.lower())
    return Rule(name, verdict, rf"^([^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(whole) + tuple(
        t for t in re.findall(f"(?<=/){TOKEN}(?=/)", f"/{path}")
    ))


#: The rules of the registered query.
RULES = (
    host_rule("block", "net/"), host_rule("allow", "example.net/en/"),
    host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_index(spark: SparkSession, tokens: DataFrame, rules) -> DataFrame:
    """(token, rule, verdict, pattern): each rule under its rarest token among the URLs.

    ``tokens`` is (token, n). Rules are a parameter of the operator and come from the driver.
    """
    schema = "token string, rule string, verdict string, pattern string"
    rows = [(t, r.name, r.verdict, r.pattern) for r in rules for t in sorted(set(r.tokens))]
    wanted = spark.createDataFrame(rows, schema)
    counted = wanted.join(tokens, "token", "left").fillna(0, ["n"])
    return counted.groupBy("rule", "verdict", "pattern").agg(
        F.min_by("token", F.struct("n", "token")).alias("token")
    )


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict; one row per page.

    Distinct (host, path) are judged once, so a hot host costs one row per path.
    """
    spark = pages.sparkSession
    urls = materialize(
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")),
        "url-parts",
    )
    words = F.array_distinct(
        F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(f"({TOKEN})"), F.lit(1))
    )
    held = urls.select("host", "path").distinct().withColumn("token", F.explode(words))
    index = materialize(
        rule_index(spark, held.groupBy("token").agg(F.count("*").alias("n")), rules), "url-index"
    )
    fits = (
        held.join(index, "token")
        .filter(F.expr("concat(host, path) rlike pattern"))
        .groupBy("host", "path")
        .agg(F.max_by(
            F.struct("rule", "verdict"),
            F.struct(F.length("rule"), (F.col("verdict") == "block").cast("int"), "rule"),
        ).alias("_best"))
    )
    return urls.join(fits, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
