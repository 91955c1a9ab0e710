"""URL filters by hashed host-suffix and path-prefix expressions, with DataFrame functions only.

A rule (host, path, action) fits urls of its host and all its subdomains whose path starts with its path. Each url is
expanded into the expressions that a rule could have: suffixes of its host at label boundaries, and prefixes of its path of
the lengths that rules have. Expressions and rules meet by an equi-join on the first 32 bits of their SHA-256; then the
full digest, host and path are compared. Of the rules that fit, the longest (host and path together) wins; ties go to the
longer host, then to block. With no rule the verdict is the default, allow.

Cases: null urls, and urls without ``://``, have an empty host and path, which only a rule with both empty fits; equal
rows and page_ids are judged each; an empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import asciilower

#: Rule rows that are broadcast at most; beyond, both sides are shuffled, with rules copied to each of SALTS.
BROADCAST_RULES = 100_000
SALTS = 32
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(("host", "path", "action"), r))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, asciilower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """key, host, path, rule and verdict of each row's url."""
    host, path = asciilower(F.col("host")), F.col("path")
    known = rules.select(host.alias("r_host"), path.alias("r_path"), F.col("action"), _digest(host, path).alias("r_digest"))
    known = known.withColumn("r_short", F.substring("r_digest", 1, 8))
    n_rules = known.count()
    lengths = [r[0] for r in known.select(F.length("r_path")).distinct().collect()]  # as many as rule paths have lengths
    url = F.col("url").cast("string")
    rows = pages.select(F.col(key), F.monotonically_increasing_id().alias("_row"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    e = rows.withColumn("e_host", F.explode(suffixes)).withColumn("e_path", F.explode_outer(prefixes)).withColumn("digest", _digest(F.col("e_host"), F.col("e_path")))
    e = e.withColumn("short", F.substring("digest", 1, 8))
    if n_rules <= BROADCAST_RULES:
        known, on = F.broadcast(known), [F.col("short") == F.col("r_short")]
    else:
        e = e.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
        known = known.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = [F.col("short") == F.col("r_short"), F.col("salt") == F.col("r_salt")]
    same = (F.col("digest") == F.col("r_digest")) & (F.col("e_host") == F.col("r_host")) & (F.col("e_path") == F.col("r_path"))
    hit = e.join(known, [*on, same], "left")
    rank = F.when(F.col("action").isNotNull(), F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("action") == "block"))
    best = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("action")), rank)
    out = hit.groupBy("_row", key, "host", "path").agg(best.alias("best"))
    return out.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH rules(r_host, r_path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rid, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT h.*, r_host || r_path AS rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(r_host || r_path) DESC NULLS LAST, length(r_host) DESC, action DESC) AS k
    FROM h LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1"""
