"""Queries of record-level operators (JON01, FLT03, AGG08, AGG14, AGG19-20, SRT02, SRT13, SRC09, SRC16, JSN01, MAP01, JON15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from ..sources import ways
from .search import table


def checked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), "c_name")
    return records.join_or_error(o, c, "key", "customer").select("o_orderkey", "c_name", "error")


def keep_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return records.keep_or_all(s, "s_nationkey", F.col("s_acctbal") > 8000)


def dominant_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = records.dominant(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_totalprice")
    return d.select("o_custkey", "o_orderpriority", F.round("share", 6).alias("share"))


def customer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 1, 50, F.asc("c_name"), F.asc("c_custkey"))


def box_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0.0).alias("west"), F.lit(-1.0).alias("south"), F.col("p_size").cast("double").alias("east"), (F.col("p_size") * 2).cast("double").alias("north"))
    return records.quarters(p)


def merged_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.create_map(F.lit("name"), "r_name", F.lit("region"), "r_name").alias("weak"), F.create_map(F.lit("name"), "n_name").alias("strong"))
    m = records.merge_tags(F.col("weak"), F.col("strong"))
    return rows.select("n_nationkey", m["name"].alias("name"), m["region"].alias("region"), F.size(m).alias("tags"))


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = records.stage_times(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id")
    return t.select("event_id", F.round("seconds", 3).alias("seconds"))


def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "built").otherwise("skipped").alias("state"))
    return records.sweep_summary(o, "o_orderpriority", "o_custkey", "state")


def name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.name_lists(table(spark, sf_dir, "part"), "p_brand", "p_type").select("p_brand", F.array_join("names", "|").alias("names"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def tag_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<[A-Za-z][^>]*>"), F.lit(0))).alias("tag"))
    return tags.select("page_id", F.explode(F.map_keys(ways.attributes(F.col("tag")))).alias("name")).groupBy("page_id", "name").agg(F.count("*").alias("n"))


def path_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = p.select(F.col("p_brand").alias("chain"), F.col("p_size").cast("long").alias("idx"), "p_partkey").groupBy("chain", "idx").agg(F.min("p_partkey").alias("k"))
    path = path.select("chain", "idx", (F.col("k") % 37).cast("double").alias("x"), (F.col("k") % 23).cast("double").alias("y"), F.col("idx").cast("double").alias("z"))
    points = p.select(F.col("p_brand").alias("chain"), F.col("p_partkey").alias("v"), (F.col("p_partkey") % 41 + 0.3137).cast("double").alias("x"), (F.col("p_partkey") % 29 + 0.1719).cast("double").alias("y"))
    return records.nearest_on_path(points, path).select("v", F.round("z", 6).alias("z"))


QUERIES = {f.__name__: f for f in (checked_join, keep_or_all, dominant_priority, customer_page, box_quarters, merged_tags, stage_times, sweep_summary, name_lists, json_props, tag_attributes, path_heights)}

ORACLES = {
    "checked_join": "SELECT o_orderkey, c_name, CASE WHEN c_custkey IS NULL THEN 'customer ' || o_custkey || ' not found' END AS error FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey",
    "keep_or_all": "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier s WHERE s_acctbal > 8000 OR NOT EXISTS (SELECT 1 FROM supplier t WHERE t.s_nationkey = s.s_nationkey AND t.s_acctbal > 8000)",
    "dominant_priority": """WITH p AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS w FROM orders GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY o_custkey) AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, o_orderpriority) AS k FROM p)
SELECT o_custkey, o_orderpriority, round(w / t, 6) AS share FROM r WHERE k = 1 AND w / t >= CAST(0.35 AS DOUBLE)""",
    "customer_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 50 OFFSET 50",
    "box_quarters": """SELECT p_partkey AS id, q AS quarter, CASE WHEN q % 2 = 0 THEN 0 ELSE p_size / 2 END::DOUBLE AS west, CASE WHEN q < 2 THEN -1 ELSE p_size - 0.5 END::DOUBLE AS south, CASE WHEN q % 2 = 0 THEN p_size / 2 ELSE p_size END::DOUBLE AS east, CASE WHEN q < 2 THEN p_size - 0.5 ELSE p_size * 2 END::DOUBLE AS north
FROM part, (VALUES (0), (1), (2), (3)) v(q)""",
    "merged_tags": "SELECT n_nationkey, n_name AS name, r_name AS region, 2 AS tags FROM nation JOIN region ON n_regionkey = r_regionkey",
    "stage_times": "SELECT event_id, round(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) / CAST(1000000 AS DOUBLE), 3) AS seconds FROM events",
    "sweep_summary": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS built, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS skipped, count(*) FILTER (WHERE o_orderstatus = 'F') AS failures, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS failed_tracks FROM orders GROUP BY o_orderpriority",
    "name_lists": "SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS names FROM part GROUP BY p_brand",
    "json_props": "SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events",
    "tag_attributes": """WITH t AS (SELECT page_id, row_number() OVER () AS n, unnest(regexp_extract_all(html, '<[A-Za-z][^>]*>')) AS tag FROM pages), u AS (SELECT page_id, n, tag, row_number() OVER () AS k FROM t)
SELECT page_id, name, count(*) AS n FROM (SELECT DISTINCT page_id, k, unnest(regexp_extract_all(tag, '([A-Za-z_:][-A-Za-z0-9_:.]*)="([^"]*)"', 1)) AS name FROM u) GROUP BY page_id, name""",
    "path_heights": """WITH a AS (SELECT p_brand AS chain, p_size AS idx, min(p_partkey) AS k FROM part GROUP BY ALL), b AS (SELECT chain, idx, CAST(k % 37 AS DOUBLE) AS x, CAST(k % 23 AS DOUBLE) AS y, CAST(idx AS DOUBLE) AS z FROM a),
s AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2, coalesce(lead(z) OVER w, first(z) OVER w) AS z2 FROM b WINDOW w AS (PARTITION BY chain ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (SELECT p_brand AS chain, p_partkey AS v, CAST(p_partkey % 41 + 0.3137 AS DOUBLE) AS px, CAST(p_partkey % 29 + 0.1719 AS DOUBLE) AS py FROM part),
t AS (SELECT *, CASE WHEN (x2 - x) ** 2 + (y2 - y) ** 2 > 0 THEN least(greatest(((px - x) * (x2 - x) + (py - y) * (y2 - y)) / ((x2 - x) ** 2 + (y2 - y) ** 2), 0), 1) ELSE 0 END AS t FROM p JOIN s USING (chain)),
r AS (SELECT v, z + t * (z2 - z) AS z, row_number() OVER (PARTITION BY v ORDER BY round((x + t * (x2 - x) - px) ** 2 + (y + t * (y2 - y) - py) ** 2, 12), idx) AS k FROM t)
SELECT v, round(z, 6) AS z FROM r WHERE k = 1""",
}
