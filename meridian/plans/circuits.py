"""Venues made of parts: routes, layouts, loops, cleaned chains, and text on plates (GRF04-06, GRF11-18, GRF24-25, SRT05-07, SRT10-11, WIN04, WIN06-07, WIN13, AGG18, AGG21, MTH07, GRD09-10, FLT05, SET05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import circuit_loops, circuits, grid, placements
from .search import table
from .shapes import CELLS, _cells

NODE = "struct<lat:double,lon:double>"


def _ways(k: Column) -> list[tuple[int, Column, list[tuple[Column, Column]]]]:
    """A ring of four ways, a shorter branch of its second, a spur and a straight far away; ``k`` is its size in hundredths of a degree."""
    a, b, c, d = ((F.lit(50.0), F.lit(5.0)), (F.lit(50.0), 5 + k * 2), (50 + k * 3, 5 + k * 2), (50 + k * 3, F.lit(5.0)))
    wide, near = (50 + k * 1.5, 5 + k * 3.2), (50 + k * 1.5, 5 + k * 2.6)
    ring, other = F.lit("Ring of parts"), F.col("p_type")
    return [(101, ring, [a, b]), (102, ring, [b, wide, c]), (103, other, [b, near, c]), (104, ring, [c, d]), (105, ring, [d, a]), (106, F.lit("Spur"), [a, (50 - k, 5 - k)]), (107, F.lit("Far straight"), [(F.lit(52.0), F.lit(5.0)), (52 + k, F.lit(5.0))])]


def _nodes(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")) for lat, lon in points])


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """Parts, dealt over the cores: Python follows, and a small file is one task."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name").repartition(3 * spark.sparkContext.defaultParallelism, "p_partkey")
    return p, _ways((F.col("p_partkey") % 100 + 100) / 10000)


def venue_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way round of each venue without its branch and spur."""
    p, ways = _parts(spark, sf_dir)
    rows = p.select(F.col("p_partkey").alias("track"), F.lit("Ring").alias("name"), F.array(*[F.struct(F.lit(n).cast("long").alias("id"), name.alias("name"), _nodes(points).alias("nodes")) for n, name, points in ways if n not in (103, 106)]).alias("ways"))
    r = circuits.best_routes(rows)
    return r.select("track", F.array_join("ways", ",").alias("ways"), F.size("nodes").alias("nodes"), F.round("metres", 3).alias("metres"), F.round("gap", 3).alias("gap"))


def venue_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layouts of each venue: its ring, and the one over the branch."""
    p, ways = _parts(spark, sf_dir)
    none = F.lit(None).cast(f"array<struct<type:string,ref:bigint,role:string,geometry:array<{NODE}>>>")
    elements = F.array(*[F.struct(F.lit("way").alias("type"), F.lit(n).cast("long").alias("id"), F.create_map(F.lit("name"), name).alias("tags"), _nodes(points).alias("geometry"), none.alias("members")) for n, name, points in ways])
    v = circuits.build_layouts(p.select(F.col("p_partkey").alias("track"), F.lit("Ring of parts").alias("name"), F.create_map().cast("map<string,double>").alias("hints"), elements.alias("elements")))
    return v.select("track", F.posexplode("layouts").alias("place", "x"), "error").select("track", "place", "x.name", F.round("x.metres", 3).alias("metres"), "x.segments", "x.variants")


def venue_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loops of each venue: within the branch, over it, and the ring."""
    p, ways = _parts(spark, sf_dir)
    rows = p.select(F.col("p_partkey").alias("track"), F.array(*[F.struct(F.lit(n).cast("long").alias("id"), F.create_map(F.lit("name"), name).alias("tags"), _nodes(points).alias("nodes")) for n, name, points in ways]).alias("ways"))
    v = circuit_loops.find_loops(rows, circuit_loops.Limits(shortest=100.0))
    return v.select("track", "junctions", "segments", F.size("unused").alias("unused"), F.explode("loops").alias("x")).select("track", "junctions", "segments", "unused", "x.loop", "x.metres", F.array_join(F.array_sort(F.transform("x.ways", lambda w: w["way_id"])), ",").alias("ways"))


def clean_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of users' events as positions, cleaned."""
    e = table(spark, sf_dir, "events")
    node = F.struct("ts", "event_id", (F.floor(F.col("value")) / 1000).cast("double").alias("lat"), (F.col("event_id") % 7 / 1000).cast("double").alias("lon"))
    chains = e.where("value is not null").groupBy(F.col("user_id").alias("chain")).agg(F.transform(F.array_sort(F.collect_list(node)), lambda n: F.struct(n["lat"], n["lon"])).alias("nodes"))
    c = circuits.cleaned_chains(chains)
    return c.select("chain", F.size("nodes").alias("nodes"), F.round(F.aggregate("nodes", F.lit(0.0), lambda s, n: s + n["lat"] + n["lon"]), 6).alias("total"))


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle of each part on the plate of its cell."""
    k = F.col("p_partkey") - 1
    r1, c1 = (F.floor(k / 20) % 20).cast("long"), (k % 20).cast("long")
    p = table(spark, sf_dir, "part")
    return p.select(F.floor(k / 400).cast("long").alias("plate"), F.col("p_partkey").alias("rect"), r1.alias("r1"), c1.alias("c1"), F.least(r1 + F.col("p_size") % 4, F.lit(19)).alias("r2"), F.least(c1 + F.col("p_size") % 5, F.lit(19)).alias("c2"))


def rect_clearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.distances(_cells(spark, sf_dir)).where("dist is not null")
    return placements.clearances(_rects(spark, sf_dir), cells).select("plate", "rect", "clearance", "edge")


def rect_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placements.rank_rectangles(_rects(spark, sf_dir)).select("plate", "rect", "place")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three line counts of a text a plate, its size by the plate's parts."""
    p = table(spark, sf_dir, "part").groupBy(F.floor((F.col("p_partkey") - 1) / 400).cast("long").alias("plate")).agg(F.max("p_size").cast("double").alias("size"))
    n = F.col("lines")
    return p.withColumn("lines", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("plate", "lines", (F.col("size") / n).alias("text_width"), (n * 4.0).alias("text_height"), F.lit(3.0).alias("line_height"), (1.0 - (n - 1) * 0.2).alias("balance"))


def text_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rects(spark, sf_dir)
    sized = r.select("plate", F.col("rect").alias("candidate"), ((F.col("c2") - F.col("c1") + 1) * 5.0).alias("width"), ((F.col("r2") - F.col("r1") + 1) * 4.0).alias("height"), (F.col("rect") % 3 / 2).alias("outside"), (F.col("rect") % 5 / 4).alias("clearance"))
    return placements.best_fits(sized, _texts(spark, sf_dir)).select("plate", "candidate", "lines", F.round("scale", 6).alias("scale"), F.round("score", 6).alias("score"))


def placement_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's lines as ranked placements the one of a rank."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("p"))
    return rows.select("l_orderkey", placements.pick(F.col("p"), F.col("l_orderkey") % 9 - 1).alias("line"))


def text_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From free rectangles to three unlike placements a plate."""
    cells = _cells(spark, sf_dir).withColumn("outside", (F.col("r") + F.col("c")) % 3 == 0)
    plates = cells.groupBy("plate").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols")).withColumn("cell_w", F.lit(6.0)).withColumn("cell_h", F.lit(5.0))
    return placements.ranked_placements(cells, plates, _texts(spark, sf_dir)).select("plate", "rank", "lines", F.round("scale", 6).alias("scale"), F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (venue_routes, venue_layouts, venue_loops, clean_chains, rect_clearances, rect_ranks, text_fits, placement_picks, text_placements)}

#: Metres of the parts of a venue: of its sides, of the ring's second way and of the branch.
SIDES = """k AS (SELECT p_partkey, p_type, (p_partkey % 100 + 100) / 10000::DOUBLE AS k FROM part), s AS (SELECT p_partkey, p_type, 111320.0::DOUBLE AS m,
  k * 2 * cos(radians(50.0::DOUBLE)) AS south, k * 2 * cos(radians(50 + k * 3)) AS north, k * 3 AS west,
  sqrt((k * 1.2 * cos(radians(50 + k * 0.75))) ** 2 + (k * 1.5) ** 2) + sqrt((k * 1.2 * cos(radians(50 + k * 2.25))) ** 2 + (k * 1.5) ** 2) AS wide,
  sqrt((k * 0.6 * cos(radians(50 + k * 0.75))) ** 2 + (k * 1.5) ** 2) + sqrt((k * 0.6 * cos(radians(50 + k * 2.25))) ** 2 + (k * 1.5) ** 2) AS near FROM k),
l AS (SELECT p_partkey, p_type, m * (south + north + west + wide) AS ring, m * (south + north + west + near) AS short, m * (wide + near) AS within FROM s)"""
RECTS = f"{CELLS}, q AS (SELECT CAST(floor((p_partkey - 1) / 400) AS BIGINT) AS plate, p_partkey AS rect, CAST(floor((p_partkey - 1) / 20) AS BIGINT) % 20 AS r1, (p_partkey - 1) % 20 AS c1, p_size FROM part), x AS (SELECT plate, rect, r1, c1, least(r1 + p_size % 4, 19) AS r2, least(c1 + p_size % 5, 19) AS c2 FROM q)"
ORACLES = {
    "venue_routes": f"WITH {SIDES} SELECT p_partkey AS track, '101,102,104,105' AS ways, 6 AS nodes, round(ring, 3) AS metres, 0.0::DOUBLE AS gap FROM l",
    "venue_layouts": f"WITH {SIDES} SELECT p_partkey AS track, 0 AS place, 'Main' AS name, round(ring, 3) AS metres, 5 AS segments, 0 AS variants FROM l UNION ALL SELECT p_partkey, 1, p_type, round(short, 3), 5, 1 FROM l",
    "venue_loops": f"""WITH {SIDES}, u AS (SELECT p_partkey, CAST(floor(within + 0.5) AS BIGINT) AS metres, '102,103' AS ways, 0 AS i FROM l UNION ALL SELECT p_partkey, CAST(floor(ring + 0.5) AS BIGINT), '101,102,104,105', 1 FROM l UNION ALL SELECT p_partkey, CAST(floor(short + 0.5) AS BIGINT), '101,103,104,105', 2 FROM l)
SELECT p_partkey AS track, 7 AS junctions, 7 AS segments, 2 AS unused, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY metres, i) AS INTEGER) AS loop, metres, ways FROM u""",
    "rect_clearances": f"""WITH {RECTS}, d AS (SELECT a.plate, a.r, a.c, min(greatest(abs(a.r - b.r), abs(a.c - b.c))) AS dist FROM g a JOIN (SELECT * FROM g WHERE blocked) b ON a.plate = b.plate GROUP BY ALL)
SELECT x.plate, rect, coalesce(min(dist), 0) AS clearance, coalesce(min(dist) FILTER (WHERE r IN (r1, r2) OR c IN (c1, c2)), 0) AS edge FROM x LEFT JOIN d ON d.plate = x.plate AND r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2 GROUP BY x.plate, rect""",
    "rect_ranks": f"WITH {RECTS} SELECT plate, rect, CAST(row_number() OVER (PARTITION BY plate ORDER BY (r2 - r1 + 1) * (c2 - c1 + 1) DESC, abs((r2 - r1) - (c2 - c1)), r1, c1) - 1 AS INTEGER) AS place FROM x",
    "text_fits": f"""WITH {RECTS}, t AS (SELECT plate, n AS lines, max(p_size) / n::DOUBLE AS tw, n * 4.0::DOUBLE AS th, 1.0::DOUBLE - (n - 1) * 0.2::DOUBLE AS balance FROM (SELECT CAST(floor((p_partkey - 1) / 400) AS BIGINT) AS plate, p_size FROM part), (VALUES (1), (2), (3)) v(n) GROUP BY plate, n),
f AS (SELECT x.plate, rect AS candidate, lines, balance, least((c2 - c1 + 1) * 5 / tw, (r2 - r1 + 1) * 4 / th, 24 * 25.4::DOUBLE / 72 / 3) AS scale, rect % 3 / 2::DOUBLE AS o, rect % 5 / 4::DOUBLE AS c FROM x JOIN t ON t.plate = x.plate),
b AS (SELECT *, scale * 3 AS mm, 16 * 25.4::DOUBLE / 72 AS low, 24 * 25.4::DOUBLE / 72 AS high, CASE WHEN balance >= 0.7 THEN 1 ELSE balance / 0.7::DOUBLE END AS w, CASE lines WHEN 2 THEN 0.75 WHEN 3 THEN 0.25 ELSE 0 END::DOUBLE AS damp FROM f WHERE scale * 3 >= 2),
s AS (SELECT *, (w + (1 - w) * damp) * (0.25 + 0.75 * o) * CASE WHEN lines = 3 THEN 0.94 ELSE 1 END::DOUBLE * CASE WHEN mm <= 2 THEN 0 WHEN mm < low THEN ((mm - 2) / (low - 2)) ** 3 * 0.6 WHEN mm <= high THEN 0.6 + 0.65 * (mm - low) / (high - low) ELSE 1.25 * (1 - (mm - high) / (low - 2)) END * (0.92 + 0.08 * c) AS score FROM b)
SELECT plate, candidate, lines, round(scale, 6) AS scale, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY plate, candidate ORDER BY score DESC, lines) AS k FROM s) WHERE k = 1""",
    "placement_picks": "WITH p AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS p FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, p[least(greatest(l_orderkey % 9 - 1, 1), len(p))] AS line FROM p",
}
