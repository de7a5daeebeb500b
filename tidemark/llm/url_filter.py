"""URL filters: host-suffix and path-prefix expressions against hashed rules.

Each url is expanded into (host suffix, path prefix) expressions, but only for
shapes some rule has: hosts of as many labels and paths of as many characters.
The expressions are joined to the rules on the first four bytes of their
SHA-256, matches are confirmed on the full digest, and the longest rule wins.
All of it is DataFrame functions.

Defined results: a null url, or one without ``://``, has empty host and path
and gets the default verdict; repeated rows each get a row; an empty rule list
leaves the default everywhere; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: (action, host, path): what the query applies.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Rules whose estimated size is under this many bytes are sent to every
#: executor; a longer list is joined by shuffling.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Columns action, host, path. Of rules for the same host and path, allow wins."""
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page rows with host, path, rule and verdict. ``rules``: action, host, path."""
    known = (
        rules.select(
            F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("r_host"),
            F.coalesce("path", F.lit("")).alias("r_path"),
            F.coalesce("action", F.lit(default)).alias("r_action"),
        )
        .groupBy("r_host", "r_path")
        .agg(F.min("r_action").alias("r_action"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("r_short", F.substring("r_digest", 1, 8))
        .withColumn("r_rank", F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "r_host", "r_path"))
    )
    shape = known.agg(
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.collect_set(F.length("r_path")).alias("lengths"),
        F.sum(F.length("r_host") + F.length("r_path") + 200).alias("bytes"),
    ).first()
    labels = F.array(*[F.lit(n) for n in sorted(shape["labels"])]).cast("array<int>")
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])]).cast("array<int>")
    if (shape["bytes"] or 0) <= BROADCAST_BYTES:
        known = F.broadcast(known)

    # A row's number is the same whenever its part of the table is read again.
    one = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("_row"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(labels, lambda k: k <= F.size(parts)),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
    )
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    tried = (
        one.withColumn("_host", F.explode_outer(suffixes))
        .withColumn("_path", F.explode_outer(prefixes))
        .withColumn("_digest", _digest(F.col("_host"), F.col("_path")))
        .withColumn("_short", F.substring("_digest", 1, 8))
    )
    # Few expressions share their four bytes with a rule by chance; the full digest tells.
    found = tried.join(known, F.col("_short") == F.col("r_short"), "left")
    true = F.col("_digest") == F.col("r_digest")
    best = found.groupBy("_row", "page_id", "host", "path").agg(F.max_by(F.when(true, F.struct("r_host", "r_path", "r_action")), F.when(true, F.col("r_rank"))).alias("r"))
    return best.select("page_id", "host", "path", F.concat("r.r_host", "r.r_path").alias("rule"), F.coalesce("r.r_action", F.lit(default)).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark, RULES))


_RULE_ROWS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
OP7_SQL = rf"""
WITH rules(action, rhost, rpath) AS (VALUES {_RULE_ROWS}),
u AS (
  SELECT row_number() OVER () AS rid, page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hit AS (
  SELECT rid, rhost || rpath AS rule, action,
    row_number() OVER (PARTITION BY rid ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS k
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM hit WHERE k = 1) USING (rid)
"""
