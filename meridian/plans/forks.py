"""Branches, forks and rings of a small way graph a customer, made of the orders (GRF03, GRF07-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forks


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a way between two of nine vertices of its customer's graph."""
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("track"), k.alias("eid"), (k % 9).alias("a"), (F.floor(k / 9) % 9).cast("long").alias("b"), (k % 100 + 1).cast("double").alias("length")).where("a <> b")


def way_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forks.branches(_ways(spark, sf_dir)).select("track", "fork", "merge", F.array_join("eids", ",").alias("eids"), "length")


def way_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections on a backbone of every other way."""
    found = forks.fork_sections(_ways(spark, sf_dir), F.col("eid") % 2 == 0)
    return found.select("track", "fork", "merge", "total", F.array_join(F.transform("branches", lambda b: F.array_join(b["eids"], ",")), "|").alias("branches"))


def way_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose ways are one ring."""
    found = forks.rings(_ways(spark, sf_dir))
    return found.select("track", F.array_join(F.array_sort("eids"), ",").alias("eids"), F.size("eids").alias("ways"), "length")


QUERIES = {f.__name__: f for f in (way_branches, way_forks, way_rings)}

WAYS = """e AS (SELECT * FROM (SELECT o_custkey AS track, o_orderkey AS eid, o_orderkey % 9 AS a, CAST(floor(o_orderkey / 9) AS BIGINT) % 9 AS b, CAST(o_orderkey % 100 + 1 AS DOUBLE) AS length FROM orders) WHERE a <> b),
arcs AS (SELECT track, a AS pos, b AS dest, eid, length FROM e UNION ALL SELECT track, b, a, eid, length FROM e), deg AS (SELECT track, pos, count(*) AS n FROM arcs GROUP BY ALL)"""
WALK = f"""{WAYS}, r AS (SELECT x.track, x.pos AS fork, dest AS head, eid AS last, [eid] AS eids, [x.pos, dest] AS seen, length FROM arcs x JOIN deg d ON d.track = x.track AND d.pos = x.pos AND d.n >= 3
  UNION ALL SELECT r.track, fork, x.dest, x.eid, list_append(eids, x.eid), list_append(seen, x.dest), r.length + x.length FROM r JOIN deg d ON d.track = r.track AND d.pos = r.head AND d.n = 2 JOIN arcs x ON x.track = r.track AND x.pos = r.head AND x.eid <> r.last WHERE NOT list_contains(seen, x.dest)),
w AS (SELECT r.*, n FROM r JOIN deg d ON d.track = r.track AND d.pos = r.head AND d.n <> 2)"""
ORACLES = {
    "way_branches": f"WITH RECURSIVE {WALK} SELECT track, fork, head AS merge, array_to_string(eids, ',') AS eids, length FROM w",
    "way_forks": f"""WITH RECURSIVE {WALK}, main AS (SELECT DISTINCT track, pos FROM arcs WHERE eid % 2 = 0), b AS (SELECT *, len(list_filter(eids, lambda x: x % 2 = 0)) > 0 AS bb FROM w WHERE fork < head AND n >= 3)
SELECT track, fork, head AS merge, sum(length) AS total, string_agg(array_to_string(eids, ','), '|' ORDER BY bb DESC, length DESC, eids) AS branches FROM b
WHERE EXISTS (SELECT 1 FROM main m WHERE m.track = b.track AND m.pos = fork) AND EXISTS (SELECT 1 FROM main m WHERE m.track = b.track AND m.pos = head) GROUP BY ALL HAVING count(*) >= 2 AND bool_or(bb)""",
    # One ring: all degrees are two, and what a vertex reaches is all vertices.
    "way_rings": f"""WITH RECURSIVE {WAYS}, ok AS (SELECT track, min(pos) AS v, count(*) AS m FROM deg GROUP BY track HAVING min(n) = 2 AND max(n) = 2),
reach AS (SELECT track, v AS pos FROM ok UNION SELECT x.track, x.dest FROM reach JOIN arcs x ON x.track = reach.track AND x.pos = reach.pos),
one AS (SELECT ok.track FROM ok JOIN reach USING (track) GROUP BY ok.track, m HAVING count(*) = m)
SELECT track, string_agg(eid, ',' ORDER BY eid) AS eids, CAST(count(*) AS INTEGER) AS ways, sum(length) AS length FROM e SEMI JOIN one USING (track) GROUP BY track""",
}
