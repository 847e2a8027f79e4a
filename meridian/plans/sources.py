"""Map text, declared layouts, ranked layouts, welded vertices, closed chains and JSON over the driver's tables (SRC05, SRC14-15, JON04-05, GRF19-21, MSH08, WIN07, WIN15, SNK02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains, crossings, layouts, stitching
from ..sources import sinks, ways
from .circuits import _nodes, _parts
from .search import table


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map a nation: its customers as nodes, one way over them and a node that is not there, one relation of the way and another."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey").cast("string")
    node = F.concat(F.lit('<node id="'), k, F.lit('" lat="'), F.col("c_acctbal").cast("string"), F.lit('" lon="1.5"/>'))
    own = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", node.alias("node"), F.concat(F.lit('<nd ref="'), k, F.lit('"/>')).alias("nd")))).alias("x"))
    rows = n.join(own, n.n_nationkey == own.c_nationkey)
    key = F.col("n_nationkey").cast("string")
    part = lambda f: F.array_join(F.transform("x", lambda v: v[f]), "")
    way = F.concat(F.lit('<way id="'), key, F.lit('">'), part("nd"), F.lit('<nd ref="999999999"/><tag k="name" v="'), F.col("n_name"), F.lit(' &amp; co"/></way>'))
    relation = F.concat(F.lit('<relation id="'), key, F.lit('"><member type="way" ref="'), key, F.lit('" role=""/><member type="way" ref="77777" role="x"/><tag k="type" v="circuit"/></relation>'))
    return rows.select(key.alias("file"), F.concat(F.lit("<osm>"), part("node"), way, relation, F.lit("</osm>")).alias("text"))


def map_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ways.ways(_maps(spark, sf_dir))
    return w.select("file", "id", F.size("geometry").alias("nodes"), F.col("tags")["name"].alias("name"), F.round(F.aggregate("geometry", F.lit(0.0), lambda s, p: s + p["lat"]), 2).alias("lat"))


def map_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ways.relations(_maps(spark, sf_dir))
    return r.select("file", "id", F.size("members").alias("members"), F.col("tags")["type"].alias("type"))


def declared_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A venue's ring as declared, and with a way that does not meet it."""
    p, parts = _parts(spark, sf_dir)
    way = {n: F.struct(F.lit(n).cast("long").alias("id"), _nodes(points).alias("nodes")) for n, _, points in parts}
    lists = F.when(F.col("p_partkey") % 2 == 0, F.array(*[way[n] for n in (102, 101, 105, 104)])).otherwise(F.array(way[102], way[104], way[107]))
    s = stitching.stitch(p.select("p_partkey", F.lit("ring").alias("layout"), lists.alias("ways")))
    return s.select("p_partkey", F.coalesce(F.size("nodes"), F.lit(-1)).alias("nodes"), F.coalesce(F.substring_index("error", "(", 1), F.lit("")).alias("error"))


def ranked_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layouts of a part, two of them of one name and two of one way, ranked and thinned."""
    p = table(spark, sf_dir, "part")
    node = lambda k, d: F.struct((F.lit(50.0) + F.lit(k) * 0.01).alias("lat"), (F.lit(5.0) + F.lit(d)).alias("lon"))
    ring = lambda d: F.array(*[node(k, d) for k in (0, 1, 2, 0)])
    row = lambda name, rank, metres, d: F.struct(name.alias("name"), F.lit(rank).alias("source_rank"), metres.cast("double").alias("metres"), F.lit("").alias("group"), ring(d).alias("nodes"))
    size = F.col("p_size") + 2000
    rows = F.array(row(F.lit("Oval"), 0, size, 0.0), row(F.lit("OVAL"), 0, size + 500, 0.0), row(F.col("p_brand"), 1, size + 3000, 0.5), row(F.lit("Main"), 0, size + 520, 0.0001))
    ranked = layouts.normalise(p.select("p_partkey", F.lit("none").alias("track_name"), rows.alias("layouts")))
    return ranked.select("p_partkey", F.array_join(F.transform("layouts", lambda x: x["name"]), "|").alias("names"))


def welded_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices on a wide grid, each a little off it by its number."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double") * 5).cast("double") + F.col("vec_id") % 3 / 1e6
    v = e.select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("v"), at(0).alias("x"), at(1).alias("y"), F.lit(0.0).alias("z"))
    return crossings.weld(v, 1e-3).select("mesh_id", "v", "rep")


def closed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's nodes closed where the ends are near (0.001 degrees a line), and the part from the third to the second."""
    node = F.struct((F.lit(50) + F.col("l_linenumber") / 5000).alias("lat"), F.lit(5.0).alias("lon"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(node)).alias("nodes"))
    closed = chains.close_if_near(rows)
    return closed.select("l_orderkey", F.size("nodes").alias("nodes"), F.size(chains.slice_closed(F.col("nodes"), F.lit(2), F.lit(1))).alias("part"))


def json_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sorted_array(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name")


QUERIES = {f.__name__: f for f in (map_ways, map_relations, declared_layouts, ranked_layouts, welded_vertices, closed_slices, json_index)}

ORACLES = {
    "map_ways": "SELECT CAST(n_nationkey AS VARCHAR) AS file, CAST(n_nationkey AS BIGINT) AS id, CAST(count(*) AS INTEGER) AS nodes, n_name || ' & co' AS name, round(sum(c_acctbal), 2) AS lat FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) >= 2",
    "map_relations": "SELECT CAST(n_nationkey AS VARCHAR) AS file, CAST(n_nationkey AS BIGINT) AS id, 2 AS members, 'circuit' AS type FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)",
    "declared_layouts": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE -1 END AS nodes, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'Layout "ring": way 107 does not connect to the previous way ' END AS error FROM part""",
    "ranked_layouts": "SELECT p_partkey, p_brand || '|Main' AS names FROM part",
    "welded_vertices": "WITH v AS (SELECT label AS mesh_id, vec_id AS v, round(CAST(embedding[1] AS DOUBLE) * 5) AS x, round(CAST(embedding[2] AS DOUBLE) * 5) AS y FROM embeddings WHERE embedding IS NOT NULL) SELECT mesh_id, v, min(v) OVER (PARTITION BY mesh_id, x, y) AS rep FROM v",
    "closed_slices": """WITH n AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS k, max(l_linenumber) - min(l_linenumber) AS far FROM lineitem GROUP BY l_orderkey), c AS (SELECT *, k + CASE WHEN k > 1 AND far / 5000::DOUBLE * 111320 <= 80 THEN 1 ELSE 0 END AS m FROM n), r AS (SELECT *, CASE WHEN m > 1 THEN m - 1 ELSE m END AS ring FROM c)
SELECT l_orderkey, CAST(m AS INTEGER) AS nodes, CAST(greatest(ring - 2, 0) + least(ring, 2) AS INTEGER) AS part FROM r""",
    "json_index": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""",
}
