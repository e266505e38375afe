"""URL filters by hashed host-suffix and path-prefix expressions.

A url is expanded into the pairs of its host's suffixes (whole labels) and its path's prefixes; the lengths
taken are those that rules have, so neither long hosts nor long paths cost more. Expressions meet rules in an
equi-join on the first 32 bits of their SHA-256; of what meets, the full digest confirms, and the longest rule wins.

Results: a null url, or one without ``://``, has an empty host and path and gets the default verdict. Equal
rules count once; if rules of one expression differ, block goes before allow. Repeated rows give repeated
results. Other columns are left aside. A url without a path doesn't start with ``/``, so no rule with a path fits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the registered query, as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> Column:
    start = F.instr(url, "://")
    return F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))


def host(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _digest(host: str, path: str) -> Column:
    return F.sha2(F.concat(F.col(host), F.col(path)), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row; ``rules`` has host, path and verdict."""
    own = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is after "allow"
    own = own.select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_chars"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_chars"), _digest("host", "path").alias("digest"),
    )
    # One number for each label count and path length among the rules: bounded by the longest rule.
    shape = own.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_chars").alias("path_chars")).first()
    alike = pages.groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    urls = alike.withColumns({"host": F.coalesce(host(), F.lit("")), "path": F.coalesce(path(), F.lit(""))})
    parts = F.split("host", r"\.")
    suffixes = [F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, F.size(parts) - n + 1, F.lit(n)))) for n in sorted(shape.labels)]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape.path_chars)]
    if not (suffixes and prefixes):
        suffixes = prefixes = [F.lit(None).cast("string")]
    expressions = (
        urls.withColumn("suffix", F.explode(F.array(*suffixes)))
        .withColumn("prefix", F.explode(F.array(*prefixes)))
        .withColumn("digest_of_url", _digest("suffix", "prefix"))
    )
    short = F.substring("digest_of_url", 1, 8) == F.substring("digest", 1, 8)
    met = expressions.join(own, short, "left")
    rule = F.struct((F.col("host_chars") + F.col("path_chars")).alias("chars"), "host_chars", "rule", "verdict")
    best = F.max(F.when(F.col("digest_of_url") == F.col("digest"), rule))
    found = met.groupBy("page_id", "url", "copies", "host", "path").agg(best.alias("best"))
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS r FROM pages
), urls AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule_host, rule_path, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
met AS (
  SELECT r, page_id, host, path, rule_host || rule_path AS rule, v,
    row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM urls LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM met WHERE place = 1
"""
