"""URL filters: pattern rules indexed by their rarest literal token.

A rule is (host, path, verdict). It fits its host and every subdomain, if the url's path starts with the rule's path.
Its literal tokens are its host's labels and those path segments that slashes enclose. Each rule is filed under the
one of these that the fewest urls hold, counted over all urls; a url's tokens fetch the rules filed under them, and
the regular expressions of these rules alone run. Rules without a literal token are filed under ``*``, which every
url holds. Among the rules that fit, the longest (host and path together) wins, then the one with the longer host,
then ``block`` before ``allow``.

Rules up to ``INLINE_RULES`` are a literal map inside one projection: no join and no shuffle of urls. More rules are
joined on the token, for each distinct (host, path) once.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the default verdict; repeated
rows are judged row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright.plans.columns import ascii_lower, pick
from bytewright.sources.tables import table

NAME = "op7_url_rules"
INLINE_RULES = 256
#: The rules of the registered query: host, path, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("_url")))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("_url")))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, "\\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit("*"))))


def rule_tokens(host: str, path: str) -> list[str]:
    """Tokens that every url fitting the rule must hold."""
    labels = [f"h:{x}" for x in host.split(".") if x]
    return list(dict.fromkeys(labels + [f"p:{x}" for x in path.split("/")[1:-1] if x]))


def rule_regex(host: str, path: str) -> str:
    """Over host and path in one string; hosts hold no slash."""
    return "^" + (f"(?:[^/]*\\.)?{re.escape(host)}(?=/|$)" if host else "[^/]*") + re.escape(path)


def _rarest(spark: SparkSession, urls: DataFrame, rules: list[tuple[str, str, str]]) -> list[str]:
    """The token under which each rule is filed. What is collected has a row for each token of the rules at most."""
    tokens = {t for h, p, _ in rules for t in rule_tokens(h, p)}
    known = spark.createDataFrame([(t,) for t in sorted(tokens)] or [("*",)], "token string")
    seen = urls.select(F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("token"))
    held = F.broadcast(known) if len(tokens) <= 100_000 else known
    counts = dict(seen.join(held, "token", "left_semi").groupBy("token").count().collect())
    return [min(rule_tokens(h, p) or ["*"], key=lambda t: (counts.get(t, 0), t)) for h, p, _ in rules]


def judge_urls(
    spark: SparkSession, urls: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", inline: int = INLINE_RULES
) -> DataFrame:
    """``urls`` has a column ``url`` and any others; returns them with host, path, rule and verdict."""
    rules = sorted(set(rules))
    keep = [c for c in urls.columns if c != "url"]
    parts = urls.withColumnRenamed("url", "_url")
    parts = parts.select(*keep, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    filed = _rarest(spark, parts, rules)
    rows = [(t, len(h) + len(p), len(h), v, h + p, rule_regex(h, p)) for t, (h, p, v) in zip(filed, rules, strict=True)]
    key = F.concat("host", "path")
    if len(rules) > inline:
        index = spark.createDataFrame(rows, "token string, size int, host_size int, verdict string, rule string, regex string")
        pairs = parts.select(key.alias("key"), "host", "path").distinct()
        pairs = pairs.select("key", F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("token"))
        fits = pairs.join(index, "token").where("key rlike regex")
        won = fits.groupBy("key").agg(F.max(F.struct("size", "host_size", "verdict", "rule")).alias("won"))
        judged = parts.withColumn("key", key).join(won, "key", "left")
    else:
        by_token: dict[str, list[tuple]] = {}
        for row in rows:
            by_token.setdefault(row[0], []).append(row[1:])
        kind = "array<struct<size:int,host_size:int,verdict:string,rule:string,regex:string>>"
        none = F.array().cast(kind)
        entries = [
            x
            for token, under in sorted(by_token.items())
            for x in (F.lit(token), F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("size", "host_size", "verdict", "rule", "regex"), strict=True))) for r in under)).cast(kind))
        ]
        index = F.create_map(*entries) if entries else None
        found = F.flatten(F.transform(_url_tokens(F.col("host"), F.col("path")), lambda t: F.coalesce(F.try_element_at(index, t), none))) if entries else none
        fits = F.filter(found, lambda r: F.rlike(F.concat(F.col("host"), F.col("path")), r["regex"]))
        judged = parts.withColumn("won", F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["host_size"], r["verdict"], r["rule"]))))
        judged = judged.withColumn("won", F.col("won").cast("struct<size:int,host_size:int,verdict:string,rule:string>"))
    return judged.select(*keep, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by ``RULES``: page_id, host, path, rule (null where none fits), verdict."""
    return judge_urls(spark, pick(table(spark, sf_dir, "pages"), "page_id", "url"), RULES)


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT row_number() OVER () AS rn, page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT rn, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rn
)
SELECT page_id, host, path, rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (rn)
"""
