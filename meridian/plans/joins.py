"""Lookup, semi, anti, spatial joins (JON01-10, JON13, AGG01, FLT02 fallback, PRJ11-12), facets (AGG09-10, FLT10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import facets, spatial


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x, y = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    return e.select(F.col("vec_id").alias("id"), x.alias("x"), y.alias("y"), F.col("label").alias("grp"))


def first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_order"), F.min_by("o_orderpriority", at).alias("priority"))


def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n.where("n_nationkey % 3 <> 0"), c.c_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("place"), F.coalesce("r_name", F.lit("unknown")).alias("country"))


def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


def filter_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.col("value") > 95
    some = F.max(keep).over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").withColumn("keep", keep).withColumn("some", some).where("keep or not some").select("user_id", "event_id")


def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return spatial.radius_pairs(p, p, 0.01).where("a_id < b_id").select("a_id", "b_id", F.round("dist", 9).alias("dist"))


def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return spatial.nearest_within(p, p, 0.05, 3).select("a_id", "b_id", "rank")


def group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.coverage(points(spark, sf_dir), 0.3)


def snap_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    cell = lambda c: F.floor(F.col(c) / 0.02 + 0.5).cast("long")
    return p.groupBy(cell("x").alias("kx"), cell("y").alias("ky")).agg(F.countDistinct("grp").alias("ways"), F.count("*").alias("n")).where("ways > 1")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, k).alias("k"))


def facet_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.census(_tagged(spark, sf_dir), ["event_type", "k"])


def facet_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.filterable(facets.census(_tagged(spark, sf_dir), ["event_type", "k"]))


def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.apply_filters(_tagged(spark, sf_dir), {"event_type": ["click"], "k": ["UNTAGGED", "3"]}).select("event_id")


QUERIES = {f.__name__: f for f in (first_order, lookup_default, missing_ids, labelled_ids, filter_or_all, radius_join, nearest_k, group_coverage, snap_junctions, facet_census, facet_keys, facet_filter)}

P = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS grp FROM embeddings)"
D = "abs(a.x - b.x) + abs(a.y - b.y)"
TAGS = "t AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN props ->> '$.k' END AS k FROM events)"
CENSUS = "c AS (SELECT 'event_type' AS key, coalesce(event_type, 'UNTAGGED') AS value, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'k', coalesce(k, 'UNTAGGED'), count(*) FROM t GROUP BY ALL)"
ORACLES = {
    "first_order": "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY o_custkey",
    "lookup_default": "SELECT c_custkey, coalesce(n_name, 'unknown') AS place, coalesce(r_name, 'unknown') AS country FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) n ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "missing_ids": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "labelled_ids": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "filter_or_all": "SELECT user_id, event_id FROM (SELECT *, bool_or(value > 95) OVER (PARTITION BY user_id) AS anyone FROM events) WHERE value > 95 OR NOT anyone",
    "radius_join": f"WITH {P} SELECT a.id AS a_id, b.id AS b_id, round({D}, 9) AS dist FROM p a JOIN p b ON a.id < b.id WHERE {D} <= 0.01",
    "nearest_k": f"WITH {P}, r AS (SELECT a.id AS a_id, b.id AS b_id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS INTEGER) AS rank FROM p a JOIN p b ON a.id <> b.id WHERE {D} <= 0.05) SELECT * FROM r WHERE rank <= 3",
    "group_coverage": f"""WITH {P}, h AS (SELECT a.grp AS ga, g.grp AS gb, a.id, bool_or({D} <= 0.3) AS hit FROM p a, (SELECT DISTINCT grp FROM p) g JOIN p b ON b.grp = g.grp WHERE a.grp <> g.grp GROUP BY ALL),
f AS (SELECT ga, gb FROM h GROUP BY ALL HAVING bool_and(hit)) SELECT f.ga AS a_group, f.gb AS b_group FROM f JOIN f g ON f.ga = g.gb AND f.gb = g.ga WHERE f.ga < f.gb""",
    "snap_junctions": f"WITH {P} SELECT CAST(floor(x / CAST(0.02 AS DOUBLE) + 0.5) AS BIGINT) AS kx, CAST(floor(y / CAST(0.02 AS DOUBLE) + 0.5) AS BIGINT) AS ky, count(DISTINCT grp) AS ways, count(*) AS n FROM p GROUP BY ALL HAVING count(DISTINCT grp) > 1",
    "facet_census": f"WITH {TAGS}, {CENSUS} SELECT * FROM c",
    "facet_keys": f"WITH {TAGS}, {CENSUS} SELECT key, CAST(sum(n) AS BIGINT) AS tagged, count(*) AS values FROM c WHERE value <> 'UNTAGGED' GROUP BY key HAVING sum(n) >= 3 AND count(*) >= 2",
    "facet_filter": f"WITH {TAGS} SELECT event_id FROM t WHERE coalesce(event_type, 'UNTAGGED') <> 'click' AND coalesce(k, 'UNTAGGED') NOT IN ('UNTAGGED', '3')",
}
