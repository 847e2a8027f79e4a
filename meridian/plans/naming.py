"""Queries of names, line breaks, runs, cut ways and shapes (STR12-16, STR20, FLT08-09, AGG15, SRT03, SET03-04, WIN09, WIN11, WIN16, JON13, JON16, SRT10, PRJ02-05, AGG07, FLT14, MTH06, MTH08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines, shapes
from ..functions import text as T
from ..operators import names, runs
from .search import table


def printed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v).cast("string") if not hasattr(v, "cast") else v for v in x]), (k % len(x) + 1).cast("int"))
    rows = p.select(
        "p_partkey", F.col("p_name").alias("label"), F.array(F.concat("p_brand", pick(" Raceway", " Grand Prix", "")), F.concat(F.lit("Circuit de "), pick("p_type", "Main", "Alternate"))).alias("aliases"),
        F.col("p_brand").alias("short_name"), F.col("p_type").alias("description"), F.array(pick(F.concat("p_name", F.lit(" Speedway")), "Inner Circuit")).alias("seen_names"), pick("Main", "Grand Prix", "National Circuit", "Layout 2", F.col("p_brand")).alias("layout"),
    )
    return names.printed_names(rows).select("p_partkey", "base_name", "suffix", "printed_name", "reason")


def two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.lines_of(2)(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, "|").alias("lines"))


def ring_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("idx"), F.col("event_type").alias("kind"))
    return runs.ring_runs(e, "kind")


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_linenumber").cast("long").alias("idx"), F.col("l_suppkey").alias("key"))


def way_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.junctions(_ways(spark, sf_dir))


def way_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.segments(_ways(spark, sf_dir).groupBy("way", "idx").agg(F.min("key").alias("key")))


def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return runs.unique_slugs(p, "p_brand", T.slug(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))), "p_partkey").select("p_partkey", "slug")


def shared_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.shared_members(table(spark, sf_dir, "events").select(F.col("event_type").alias("owner"), F.dayofmonth("ts").alias("group"), F.col("user_id").alias("member")))


def ring_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    ring = F.array(*[F.struct(at(i).alias("x"), at(i + 1).alias("y")) for i in range(0, 10, 2)])
    x, y = shapes.rotate(at(10), at(11), F.lit(90))
    rows = e.select("vec_id", ring.alias("ring"), x.alias("x"), y.alias("y"), shapes.triangle_area([at(0), at(1), at(2)], [at(3), at(4), at(5)], [at(6), at(7), at(8)]).alias("t"))
    area = shapes.signed_area(F.col("ring"))
    return rows.select("vec_id", F.round(area, 6).alias("area"), F.round(shapes.signed_area(shapes.counter_clockwise(F.col("ring"))), 6).alias("ccw_area"), shapes.contains(F.col("ring"), F.col("x"), F.col("y")).cast("int").alias("inside"), F.round("t", 6).alias("triangle"))


QUERIES = {f.__name__: f for f in (printed_names, two_lines, ring_runs, way_junctions, way_segments, unique_slugs, shared_members, ring_areas)}

X = [f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(12)]
SHOE = " + ".join(f"({X[i]} * {X[(i + 3) % 10]} - {X[(i + 2) % 10]} * {X[i + 1]})" for i in range(0, 10, 2))
QX, QY = X[11], f"(-{X[10]})"
HIT = " + ".join(f"(CASE WHEN ({X[i + 1]} > {QY}) <> ({X[(i + 3) % 10]} > {QY}) AND {QX} < ({X[(i + 2) % 10]} - {X[i]}) * ({QY} - {X[i + 1]}) / nullif({X[(i + 3) % 10]} - {X[i + 1]}, 0) + {X[i]} THEN 1 ELSE 0 END)" for i in range(0, 10, 2))
CROSS = [f"({X[3 + i]} - {X[i]}) * ({X[6 + j]} - {X[j]}) - ({X[3 + j]} - {X[j]}) * ({X[6 + i]} - {X[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
JUNCTIONS = "j AS (SELECT arg_min(key, idx) AS key FROM w GROUP BY way HAVING count(*) >= 2 UNION SELECT arg_max(key, idx) FROM w GROUP BY way HAVING count(*) >= 2 UNION SELECT key FROM w GROUP BY key HAVING count(DISTINCT way) > 1)"
ORACLES = {
    "two_lines": """WITH w AS (SELECT p_partkey, list_filter(string_split_regex(p_name || ' ' || p_type, '\\s+'), lambda x: x <> '') AS w FROM part),
c AS (SELECT p_partkey, w, i, len(array_to_string(w[:i], ' ')) AS a, len(array_to_string(w[i + 1:], ' ')) AS b, (len(array_to_string(w, ' '))) / 2.0 AS t FROM w, range(1, 20) r(i) WHERE i < len(w)),
d AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY (t - a) * (t - a) + (t - b) * (t - b) + CASE WHEN i = len(w) - 1 AND len(w) > 2 AND b / t < 0.65 THEN 10 * t * t ELSE 0 END, i) AS k FROM c)
SELECT p_partkey, array_to_string(w[:i], ' ') || '|' || array_to_string(w[i + 1:], ' ') AS lines FROM d WHERE k = 1""",
    "ring_runs": """WITH a AS (SELECT user_id AS chain, event_id AS idx, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events),
b AS (SELECT chain, kind, count(*) AS size, min(idx) AS start FROM a GROUP BY chain, kind, g), c AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY start) AS k, count(*) OVER (PARTITION BY chain) AS n FROM b),
d AS (SELECT f.chain, l.size AS more, l.start AS was FROM c f JOIN c l ON f.chain = l.chain AND f.k = 1 AND l.k = l.n AND l.n > 1 AND f.kind = l.kind)
SELECT chain, k - 1 AS run, kind, CAST(CASE WHEN k = 1 THEN size + coalesce(more, 0) ELSE size END AS BIGINT) AS size, CASE WHEN k = 1 THEN coalesce(was, start) ELSE start END AS start FROM c LEFT JOIN d USING (chain) WHERE more IS NULL OR k < n""",
    "way_junctions": f"WITH w AS (SELECT l_orderkey AS way, l_linenumber AS idx, l_suppkey AS key FROM lineitem), {JUNCTIONS} SELECT DISTINCT key FROM j",
    "way_segments": f"""WITH w AS (SELECT l_orderkey AS way, CAST(l_linenumber AS BIGINT) AS idx, min(l_suppkey) AS key FROM lineitem GROUP BY ALL), {JUNCTIONS},
s AS (SELECT way, idx AS from_idx, lead(idx) OVER o AS to_idx, key AS src, lead(key) OVER o AS dst, row_number() OVER o - 1 AS segment FROM w WHERE key IN (SELECT key FROM j) WINDOW o AS (PARTITION BY way ORDER BY idx)) SELECT * FROM s WHERE to_idx IS NOT NULL""",
    "unique_slugs": "WITH s AS (SELECT p_partkey, lower(regexp_replace(p_brand || '-' || p_size, '[^A-Za-z0-9]+', '-', 'g')) AS s FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM s) SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug FROM n",
    "shared_members": """WITH d AS (SELECT DISTINCT event_type AS owner, day(ts) AS g, user_id AS m FROM events), n AS (SELECT owner, count(DISTINCT g) AS gs FROM d GROUP BY owner), p AS (SELECT owner, m, count(*) AS k FROM d GROUP BY owner, m)
SELECT owner, count(*) FILTER (WHERE k = gs) AS everywhere, count(*) AS anywhere, count(*) FILTER (WHERE k = gs) / count(*) AS ratio FROM p JOIN n USING (owner) GROUP BY owner""",
    "ring_areas": f"SELECT vec_id, round(({SHOE}) / 2, 6) AS area, round(abs(({SHOE}) / 2), 6) AS ccw_area, CAST(({HIT}) % 2 AS INTEGER) AS inside, round(sqrt(({CROSS[0]}) ** 2 + ({CROSS[1]}) ** 2 + ({CROSS[2]}) ** 2) / 2, 6) AS triangle FROM embeddings",
}
