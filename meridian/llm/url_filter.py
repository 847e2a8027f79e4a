"""URL rules matched by hash prefixes.

A URL is expanded into host suffixes (at label bounds) times path prefixes; only label counts and path lengths that some
rule has are tried. Expansions meet the rules on the first 32 bits of their SHA-256 and are confirmed by the whole
digest; of the rules that fit, the longest wins (then the longer host, then block before allow). A page that no rule
fits gets the method's verdict, allow: the list names what is judged, all else passes.

Rules are joined by broadcast while their table is under ``broadcast_rules`` rows, by exchange beyond. Equal URLs are
judged once. Defined results: null URLs and those without ``://`` have an empty host and path and pass; rows keep their
page_id, null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path), empty where there is none."""
    after = F.when(url.contains("://"), F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = spark.createDataFrame([(v, h, p) for v, h, p in rules], "rule_verdict string, rule_host string, rule_path string")
    rows = rows.withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256))
    return rows.withColumn("short", F.substring("digest", 1, 8))


def judge(df: DataFrame, rules=RULES, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """One row per row: page_id, host, path, rule, verdict."""
    spark = df.sparkSession
    urls = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = url_parts(F.col("url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path")).groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels])) if labels else F.array()
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths])) if lengths else F.array()
    tried = urls.select("page_id", "host", "path", "copies", F.explode_outer(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", s, p), 256))))).alias("try"))
    tried = tried.withColumn("try_short", F.substring("try", 1, 8))
    table = rule_table(spark, rules)
    table = F.broadcast(table) if len(rules) <= broadcast_rules else table
    met = tried.join(table, (F.col("try_short") == F.col("short")) & (F.col("try") == F.col("digest")), "left")
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("rule_verdict"), F.concat("rule_host", "rule_path").alias("rule"))
    best = met.groupBy("page_id", "host", "path", "copies").agg(F.max(F.when(F.col("digest").isNotNull(), order)).alias("best"))
    out = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.drop("copy")
