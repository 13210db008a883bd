"""URL filter rules, indexed by their rarest literal token (DataFrame and SQL functions only).

A rule is (host, path, verdict): it fits its host and all subdomains where the
path starts with the rule's. Its pattern is a regular expression over
``host + path``; its literal tokens are the runs of letters and digits in it.

1. URLs are reduced to distinct (host, path) pairs; equal URLs are judged once.
2. Every pair's distinct tokens fetch the rules indexed under them. A rule is
   indexed under the one of its tokens that the fewest pairs contain (counted
   over all pairs; only tokens that occur in rules are counted).
3. Only the fetched candidates run their regular expression; the longest
   fitting rule (host + path) decides, else ``default`` does.

Defined cases: a null url, or one without ``://``, has empty host and path and
gets the default verdict (a rule without tokens is matched against every pair).
Equal longest rules: the smaller (rule, verdict) wins. No rules: all get the
default. Repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe.llm.common import small, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
RULE_SCHEMA = "host string, path string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _runs(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(text, r"[^0-9A-Za-z]+"), ""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct literal tokens of a url's host and path."""
    return _runs(F.concat_ws("/", host, path))


def rule_index(rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """(token, rule, pattern, verdict): each rule once, under its rarest token ('' if it has none).

    A run of letters at the end of a rule's path may go on in a url, so it is no token.
    """
    quoted = [F.concat(F.lit("\\Q"), F.replace(F.col(c), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
              for c in ("host", "path")]
    end = F.when(F.col("path") == "", F.lit("(/|$)")).otherwise(F.lit(""))
    rules = (rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
                          F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .select(F.concat("host", "path").alias("rule"), "verdict",
                     F.concat(F.lit("^([^/]*\\.)?"), *quoted, end).alias("pattern"),
                     tokens_of(F.col("host"), F.regexp_replace("path", r"[0-9A-Za-z]+$", "")).alias("tokens"))
             .distinct())
    tokens = rules.select(F.explode("tokens").alias("token")).distinct()
    n = tokens.count()
    seen = (pairs.select(F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token"))
            .join(small(tokens, n), "token").groupBy("token").agg(F.count(F.lit(1)).alias("pairs")))
    per_token = (rules.select("rule", "verdict", "pattern", F.explode_outer("tokens").alias("token"))
                 .join(seen, "token", "left"))
    rarest = F.min(F.struct(F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("token", F.lit("")).alias("token")))
    return per_token.groupBy("rule", "verdict", "pattern").agg(rarest["token"].alias("token"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    page_id = F.col("page_id") if "page_id" in pages.columns else F.lit(None).cast("long")
    host, path = host_and_path(url)
    rows = pages.select(page_id.alias("page_id"), host.alias("host"), path.alias("path"))
    pairs = stored(rows.select("host", "path").distinct(), "url-pairs")
    index = stored(rule_index(rules, pairs), "url-rules")
    n_rules, bare = index.agg(F.count(F.lit(1)), F.max(F.col("token") == "")).first()
    tokens = tokens_of(F.col("host"), F.col("path"))
    tokens = F.concat(tokens, F.array(F.lit(""))) if bare else tokens
    hits = (pairs.select("host", "path", F.explode(tokens).alias("token"))
            .join(small(index, n_rules), "token")
            .where(F.expr("concat(host, path) rlike pattern"))
            .groupBy("host", "path")
            .agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("best")))
    return rows.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def contract_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


SQL = """
WITH rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
r AS (SELECT row_number() OVER () AS rid, page_id,
             CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT rid, h || p AS rule, verdict,
             row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, h || p) AS k
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)
"""
