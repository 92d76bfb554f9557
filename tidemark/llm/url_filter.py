"""URL rules by hashed expressions: host suffixes x path prefixes, an equi-join on short hash prefixes, full digests.

A rule is (rule_host, rule_path, verdict). A url fits it if its host is the rule's or a subdomain of it and its path
starts with the rule's. Only suffixes with a number of labels and prefixes of a length that some rule has are made, which
loses nothing: no other expression can equal a rule. Urls are first reduced to distinct (host, path), so a hot url or site
is expanded once a path; the join on the first 8 hex digits of SHA-256 is small against it and Catalyst broadcasts the
rules only under its own size limit. Candidates that share the short prefix are confirmed by the whole digest; of those
left the longest rule wins (then the longer host; of equal rules block wins).

Null urls or ones without :// have empty host and path and get the default verdict; repeated rows stay; an empty table
gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, without

#: host, path, verdict of the standing rules.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
#: Hex digits of the short prefix that rules and expressions are joined on.
SHORT = 8


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host (A-Z lower-cased) and path."""
    u = F.col(f"`{url}`")
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return without(df, ("host", "path")).withColumns({"host": lower_ascii(host), "path": path})


def rule_table(rules: DataFrame) -> DataFrame:
    text = F.concat("rule_host", "rule_path")
    return rules.where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull()).select(
        "rule_host", "rule_path", "verdict", text.alias("rule"), F.sha2(text, 256).alias("rule_digest"), F.left(F.sha2(text, 256), F.lit(SHORT)).alias("short")
    )


def expressions(keys: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """keys (host, path) with one row for each expression that a rule could equal: expr, digest, short."""
    hosts = F.expr(f"transform(filter(array({','.join(map(str, labels))}), k -> k <= size(split(host, '[.]', -1))), k -> substring_index(host, '.', -k))")
    paths = F.expr(f"transform(filter(array({','.join(map(str, lengths))}), k -> k <= length(path)), k -> left(path, k))")
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    out = keys.select("host", "path", F.explode(both).alias("expr"))
    return out.withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.left("digest", F.lit(SHORT)))


def judge(df: DataFrame, rules: DataFrame, *, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict."""
    table = rule_table(rules)
    # one row: the label counts and path lengths that rules have
    shape = table.agg(F.collect_set(F.size(F.split("rule_host", "[.]", -1))).alias("k"), F.collect_set(F.length("rule_path")).alias("n")).first()
    pages = split_url(without(df, ("rule", "verdict")), url)
    if not shape["k"]:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = pages.select("host", "path").where(F.col("host") != "").distinct()
    found = expressions(keys, sorted(shape["k"]), sorted(shape["n"])).join(table, "short").where(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule"), F.length("rule_host"), (F.col("verdict") == "block").cast("int"), "rule")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("_best"))
    return pages.join(best, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in pages.columns], F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")
    )


def op2(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(RULES, "rule_host string, rule_path string, verdict string")
    return judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH r(rule_host, rule_path, verdict) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM a),
c AS (SELECT row_number() OVER () AS n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM b),
m AS (SELECT c.n, arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule,
             arg_max(r.verdict, length(r.rule_host || r.rule_path)) AS verdict
      FROM c JOIN r ON (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path) GROUP BY c.n)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM c LEFT JOIN m USING (n)
"""
