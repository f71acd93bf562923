"""URL filters: expand every URL into host-suffix and path-prefix expressions and look their hashes up.

An expression is a host suffix (whole labels) joined to a prefix of the path. Expressions meet the rules in an
equi-join on the first four bytes of their SHA-256; full digests then confirm, and the longest rule that fits a
URL gives the verdict (of two equally long ones the rule of the longer host).  URLs are judged once for all rows
that carry them.

Prefix lengths of the path are the lengths that occur among the rules, so that "starts with" holds for every
character and an URL makes (labels of the host) x (lengths in the rules) expressions at most.

Defined results: null URLs and those without ``://`` have an empty host and path, no rule, and the default
verdict; URLs of any length are judged whole; repeated rows all get the same verdict; extra columns pass through,
whatever their names, and columns named like the ones added are replaced; an empty rule table gives every page the
default verdict, and an empty table of pages no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are broadcast up to this many; more are joined by a shuffle.
BROADCAST_RULES = 50_000


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def label_count(host: str) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."))) + 1


def expressions(urls: DataFrame, lengths: list[int], labels: list[int]) -> DataFrame:
    """One row for each (url, host suffix, path prefix) with its digest and short hash prefix.

    Suffixes and prefixes have as many labels and characters as some rule has, so a host of any length makes few.
    """
    counts = F.filter(F.array(*map(F.lit, labels)), lambda n: n <= label_count("host"))
    suffixes = F.transform(counts, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    sizes = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    out = urls.filter("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix"), sizes.alias("sizes"))
    out = out.select("url", "suffix", "path", F.explode("sizes").alias("n"))
    # a path starts with "/", which no host holds: where the host ends is plain
    out = out.select("url", digest(F.concat("suffix", F.expr("substring(path, 1, n)"))).alias("full"))
    return out.withColumn("short", F.substring("full", 1, 8))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every page by its ``url``."""
    listed = rules.select(
        F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_length"), "rule_verdict",
        F.length("rule_path").alias("path_length"), label_count("rule_host").alias("labels"),
    ).withColumn("rule_full", digest(F.col("rule"))).withColumn("rule_short", F.substring("rule_full", 1, 8))
    # the lengths of rules' paths and hosts: as many as a rule has characters or labels at most
    lengths, labels = (sorted(r[0] for r in listed.select(c).distinct().collect() if r[0] is not None) for c in ("path_length", "labels"))
    if listed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    host, path = host_and_path(F.col("url"))
    urls = pages.select("url").filter("url IS NOT NULL").distinct().select("url", host.alias("host"), path.alias("path"))
    best = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "host_length", "rule"))
    hits = (
        expressions(urls, lengths or [0], labels or [1]).join(listed, F.col("short") == F.col("rule_short")).filter("full = rule_full")
        .groupBy("url").agg(best.alias("hit"))
    )
    pages = pages.drop("host", "path", "rule", "verdict")
    key, of, hit = fresh(pages, "key", "url_of", "hit")
    hits = hits.select(F.col("url").alias(of), F.col("hit").alias(hit))
    # null URLs find nothing; keys of their own spread them
    spread = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    pages = pages.withColumns({"host": host, "path": path, key: F.coalesce("url", spread)})
    out = pages.join(hits, F.col(key) == F.col(of), "left")
    return out.withColumn("rule", F.col(f"{hit}.rule")).withColumn("verdict", F.coalesce(F.col(f"{hit}.rule_verdict"), F.lit(default))).drop(key, of, hit)


def query(pages: DataFrame) -> DataFrame:
    rules = rule_table(pages.sparkSession)
    return judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT row_number() OVER () AS i, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
h AS (SELECT i, rh || rp AS rule, v, row_number() OVER (PARTITION BY i ORDER BY length(rh || rp) DESC, length(rh) DESC, rh || rp DESC) AS k
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM h WHERE k = 1) USING (i)
"""
