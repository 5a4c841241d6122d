"""URL filters, in DataFrame functions alone.

Each URL is expanded into host-suffix and path-prefix expressions, these meet the rules in an
equi-join on a short hash prefix, full digests confirm, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end.
    Both empty for a null URL or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "r_host string, r_path string, r_verdict string")


def judge(pages: DataFrame, rules: DataFrame | tuple = RULES, default: str = "allow", prefix_chars: int = 8) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest host, then
    the longest path, wins, then block before allow. No rule: null and the default. The verdict depends
    on host and path alone, so distinct hosts and paths (cut to the longest rule path) are judged once,
    which also takes out hot hosts before any shuffle of expressions. Null and malformed URLs have an
    empty host and path and get the default; repeated rows stay; other columns are ignored.
    Rules can be any number: their join is broadcast only if their size, checked, is small.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    table = table.where("r_host is not null and r_path is not null")
    lengths, = table.agg(F.array_sort(F.collect_set(F.length("r_path"))).alias("n"), ).collect()
    lengths = [int(x) for x in lengths[0] or []]  # as many as there are different lengths of rule paths
    longest = max(lengths, default=0)
    host, path = host_and_path(F.col("url").cast("string"))
    slim = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("cut", F.substring("path", 1, longest))
    keys = slim.where("host <> ''").select("host", "cut").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.filter(F.array(*[F.substring("cut", 1, n) for n in lengths] or [F.lit("")]), lambda p: p.isNotNull())
    paths = F.array_distinct(paths)
    expressions = keys.select("host", "cut", F.explode(F.flatten(F.transform(suffixes, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("\n"), p))))).alias("expression"))
    expressions = expressions.select("host", "cut", F.sha2(F.encode("expression", "UTF-8"), 256).alias("digest"))
    digest = F.sha2(F.encode(F.concat("r_host", F.lit("\n"), "r_path"), "UTF-8"), 256)
    hashed = table.select(F.struct(F.length("r_host").alias("hl"), F.length("r_path").alias("pl"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")).alias("best"), digest.alias("r_digest"))
    hashed = hashed.withColumn("r_prefix", F.substring("r_digest", 1, prefix_chars))
    rule_bytes = table.agg(F.sum(F.length("r_host") + F.length("r_path") + 200)).collect()[0][0] or 0
    if rule_bytes <= BROADCAST_BYTES:
        hashed = F.broadcast(hashed)
    met = expressions.withColumn("prefix", F.substring("digest", 1, prefix_chars)).join(hashed, F.col("prefix") == F.col("r_prefix"))
    best = met.where("digest = r_digest").groupBy("host", "cut").agg(F.max("best").alias("best"))
    out = slim.join(best, ["host", "cut"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
