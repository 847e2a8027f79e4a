"""Queries over ordered chains: events of a user as positions (AGG02-06, PRJ01, PRJ06-08, WIN01-03, WIN05, WIN07-08, WIN10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import chains

POINTS = """p AS (
  SELECT user_id AS chain, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS idx, event_type AS kind, event_id, value,
    40 + value / 1000 AS lat, CAST(event_id % 1000 AS DOUBLE) / 10000 AS lon FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return e.select(F.col("user_id").alias("chain"), idx.alias("idx"), F.col("event_type").alias("kind"), "event_id", "value", (40 + F.col("value") / 1000).alias("lat"), ((F.col("event_id") % 1000).cast("double") / 10000).alias("lon"))


def chain_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = chains.measures(points(spark, sf_dir))
    return m.select("chain", "points", *[F.round(c, 4).alias(c) for c in ("length_m", "gap_m", "area_m2", "mean_lat", "mean_lon")])


def chain_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.project(F.col("lat"), F.col("lon"), "chain")
    return points(spark, sf_dir).select("chain", "idx", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


def elevation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, o = Window.partitionBy("chain"), Window.partitionBy("chain").orderBy("idx")
    scaled = points(spark, sf_dir).withColumn("h", geo.exaggerate(F.col("value"), w, 1.5))
    return scaled.select("chain", "idx", F.round(geo.smooth(F.col("h"), w, o), 9).alias("elevation"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    tx, ty, px, py = geo.tile(F.col("lat"), F.col("lon"))
    return p.select("event_id", tx.alias("tile_x"), ty.alias("tile_y"), px.alias("pixel_x"), py.alias("pixel_y"), geo.tile_height(tx % 256, ty % 256, px.cast("double")).alias("height"))


def chain_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.samples(chains.collect(points(spark, sf_dir)), 24).select("chain", F.posexplode("samples").alias("k", "s")).select("chain", "k", F.col("s.idx").alias("idx"))


def chain_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.islands(points(spark, sf_dir), F.col("kind") != "click").groupBy("chain", "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n")).drop("island")


def chain_backtracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.backtracks(points(spark, sf_dir)).where("backtrack").select("chain", "idx")


def chain_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = chains.drop_near_duplicates(chains.collect(points(spark, sf_dir)), 0.02)
    return kept.select("chain", F.size("nodes").alias("n_before"), F.size("kept").alias("n_after"), F.element_at("kept", -1)["idx"].alias("last_idx"))


QUERIES = {f.__name__: f for f in (chain_measures, chain_projection, elevation_profile, tiles, chain_samples, chain_islands, chain_backtracks, chain_near_duplicates)}

NEXT = "lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2"
DIST = "sqrt(pow((lon2 - lon) * 111320.0 * cos(radians((lat + lat2) / 2)), 2) + pow((lat2 - lat) * 111320.0, 2))"
ORACLES = {
    "chain_measures": f"""WITH {POINTS}, s AS (SELECT *, {NEXT} FROM p WINDOW w AS (PARTITION BY chain ORDER BY idx)),
ends AS (SELECT chain, arg_min(lat, idx) AS lat, arg_min(lon, idx) AS lon, arg_max(lat, idx) AS lat2, arg_max(lon, idx) AS lon2 FROM p GROUP BY chain),
g AS (SELECT chain, count(*) AS points, coalesce(sum({DIST}), 0) AS length_m, (max(lat) - min(lat)) * 111320.0 * (max(lon) - min(lon)) * 111320.0 * cos(radians((min(lat) + max(lat)) / 2)) AS area_m2, avg(lat) AS mean_lat, avg(lon) AS mean_lon FROM s GROUP BY chain)
SELECT chain, points, round(length_m, 4) AS length_m, round({DIST}, 4) AS gap_m, round(area_m2, 4) AS area_m2, round(mean_lat, 4) AS mean_lat, round(mean_lon, 4) AS mean_lon FROM g JOIN ends USING (chain)""",
    "chain_projection": f"""WITH {POINTS}, c AS (SELECT *, avg(lat) OVER (PARTITION BY chain) AS lat0, avg(lon) OVER (PARTITION BY chain) AS lon0 FROM p)
SELECT chain, idx, round((lon - lon0) * 111320.0 * cos(radians(lat0)), 5) AS x, round((lat - lat0) * 111320.0, 5) AS y FROM c""",
    "elevation_profile": f"""WITH {POINTS}, h AS (SELECT chain, idx, (value - min(value) OVER (PARTITION BY chain)) * 1.5 AS h, count(*) OVER (PARTITION BY chain) AS n FROM p),
s AS (SELECT *, coalesce(lag(h) OVER w, last_value(h) OVER (PARTITION BY chain ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS a, coalesce(lead(h) OVER w, first_value(h) OVER w) AS b FROM h WINDOW w AS (PARTITION BY chain ORDER BY idx))
SELECT chain, idx, round(CASE WHEN n < 3 THEN h ELSE h + ((a + 2 * h + b) / 4 - h) * CAST(0.35 AS DOUBLE) END, 9) AS elevation FROM s""",
    "tiles": f"""WITH {POINTS}, f AS (SELECT event_id, (lon + 180) / 360 * 8192 AS fx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8192 AS fy FROM p)
SELECT event_id, CAST(floor(fx) AS BIGINT) AS tile_x, CAST(floor(fy) AS BIGINT) AS tile_y, CAST(floor((fx - floor(fx)) * 256) AS BIGINT) AS pixel_x, CAST(floor((fy - floor(fy)) * 256) AS BIGINT) AS pixel_y,
  CAST(floor(fx) AS BIGINT) % 256 * 256 + CAST(floor(fy) AS BIGINT) % 256 + floor((fx - floor(fx)) * 256) / 256 - 32768 AS height FROM f""",
    "chain_samples": f"""WITH {POINTS}, n AS (SELECT chain, count(*) AS n FROM p GROUP BY chain)
SELECT chain, CAST(k AS INTEGER) AS k, CAST(floor(k * n / 24) AS BIGINT) AS idx FROM n, range(24) r(k) WHERE n >= 24
UNION ALL SELECT chain, CAST(idx AS INTEGER), idx FROM p JOIN n USING (chain) WHERE n < 24""",
    "chain_islands": f"""WITH {POINTS}, f AS (SELECT chain, idx, idx - row_number() OVER (PARTITION BY chain ORDER BY idx) AS g FROM p WHERE kind <> 'click')
SELECT chain, min(idx) AS first, max(idx) AS last, count(*) AS n FROM f GROUP BY chain, g""",
    "chain_backtracks": f"""WITH {POINTS}, s AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS b, lead(lat) OVER w AS c, lead(lon) OVER w AS d FROM p WINDOW w AS (PARTITION BY chain ORDER BY idx))
SELECT chain, idx FROM s WHERE (lat - a) * (c - lat) + (lon - b) * (d - lon) < -0.9 * sqrt(pow(lat - a, 2) + pow(lon - b, 2)) * sqrt(pow(c - lat, 2) + pow(d - lon, 2))""",
    "chain_near_duplicates": f"""WITH RECURSIVE {POINTS}, n AS (SELECT chain, CAST(count(*) AS INTEGER) AS n FROM p GROUP BY chain), r AS (
  SELECT chain, idx, lat, lon, 1 AS k FROM p WHERE idx = 0
  UNION ALL SELECT r.chain, q.idx, q.lat, q.lon, r.k + 1 FROM r, LATERAL (SELECT idx, lat, lon FROM p WHERE p.chain = r.chain AND p.idx > r.idx AND abs(p.lat - r.lat) + abs(p.lon - r.lon) >= 0.02 ORDER BY idx LIMIT 1) q)
SELECT chain, any_value(n) AS n_before, CAST(max(k) AS INTEGER) AS n_after, max(idx) AS last_idx FROM r JOIN n USING (chain) GROUP BY chain""",
}
