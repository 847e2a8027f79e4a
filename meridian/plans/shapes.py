"""Graphs, grids, placements and meshes over the driver's tables (GRF01-02, GRF22-23, GRD, AGG22, MTH02-04, WIN12-13, MSH)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, grid, mesh


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst"))
    return pairs.distinct()


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_supply(spark, sf_dir))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_supply(spark, sf_dir))


def graph_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("src")), n.select(F.col("n_nationkey").alias("dst"))
    ring = a.join(b, b.dst == a.src + 1).unionByName(a.join(b, b.dst == a.src + 3)).withColumn("eid", F.col("src") * 100 + F.col("dst")).withColumn("length", (F.col("src") * 7 % 11 + 1).cast("double"))
    return graph.loops(ring, 6, 4.0, 60.0)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select((k - 1).alias("k"), "p_brand").select(F.floor(F.col("k") / 400).cast("long").alias("plate"), (F.floor(F.col("k") / 20) % 20).cast("long").alias("r"), (F.col("k") % 20).cast("long").alias("c"), F.col("p_brand").isin("Brand#11", "Brand#1", "Brand#23").alias("blocked"))


def grid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.prefix_sums(_cells(spark, sf_dir), F.col("blocked").cast("long")).select("plate", "r", "c", "total")


def grid_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dilate(_cells(spark, sf_dir), 1).select("plate", "r", "c", F.col("near").cast("int").alias("near"))


def grid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.distances(_cells(spark, sf_dir)).select("plate", "r", "c", F.coalesce("dist", F.lit(-1)).alias("dist"))


def placement_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    lines = F.explode(F.sequence(F.lit(1), F.lit(4)))
    rows = p.select("p_brand", "p_partkey", "p_size", "p_retailprice", lines.alias("lines"))
    score = grid.placement_score(F.col("p_size") / F.col("lines") / 2.0, F.col("lines"), (F.col("p_partkey") % 10) / 10.0, (F.col("p_size") % 5) / 4.0, (F.col("p_partkey") % 7) / 6.0, (F.col("p_partkey") % 3) / 2.0)
    best = grid.best_of_groups(rows.withColumn("score", F.round(score, 9)), "p_brand", 3, F.desc("score"), F.asc("p_partkey"), F.asc("lines"))
    return best.select("p_brand", "p_partkey", "lines", "score", "rank")


def placement_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("items"))
    kept = grid.keep_unlike(F.col("items"), rows.schema["items"].dataType.simpleString(), lambda k, x: F.abs(k["p_size"] - x["p_size"]) <= 2, 3)
    return rows.select("p_brand", F.size(kept).alias("kept"), F.size("items").alias("items"))


def _tris(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    key = lambda i: F.concat_ws(":", *[F.floor(F.get("embedding", F.lit(i + j)).cast("double") / 0.2 + 0.5).cast("long") for j in range(2)])
    return e.select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("tri"), key(0).alias("ka"), key(2).alias("kb"), key(4).alias("kc"))


def mesh_non_manifold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.non_manifold(_tris(spark, sf_dir))


def mesh_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.flipped(_tris(spark, sf_dir))


def mesh_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.summary(_tris(spark, sf_dir)).select("mesh_id", "triangles", "degenerate", "vertices", "non_manifold", "flipped")


def mesh_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.vertex_dictionary(_tris(spark, sf_dir))


def mesh_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.shell_counts(_tris(spark, sf_dir))


def mesh_t_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.floor(F.get("embedding", F.lit(i)).cast("double") / 0.1 + 0.5) / 10
    v = e.select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("v"), at(0).alias("x"), at(1).alias("y"), F.lit(0.0).alias("z"))
    s = e.select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("e"), at(0).alias("ax"), at(1).alias("ay"), F.lit(0.0).alias("az"), at(2).alias("bx"), at(3).alias("by"), F.lit(0.0).alias("bz"))
    return mesh.t_junctions(v, s, 1e-4, 0.1)


def grid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("plate"), (F.col("p_size") % 7 + 1.3).alias("w"), (F.col("p_size") % 5 + 1.6).alias("h"))
    corners = [("w", 0.0, "w", "h"), ("w", "h", 0.2, "h"), (0.2, "h", 0.2, 0.0), (0.2, 0.0, "w", 0.0)]
    side = lambda s: F.struct(*[(F.col(v) if isinstance(v, str) else F.lit(v)).cast("double").alias(n) for v, n in zip(s, ("x1", "y1", "x2", "y2"))])
    rings = p.select("plate", F.explode(F.array(*map(side, corners))).alias("e")).select("plate", "e.*")
    return grid.fill_interior(rings, p.select("plate", F.lit(5).alias("rows"), F.lit(6).alias("cols")), 1.0)


def grid_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.empty_rectangles(_cells(spark, sf_dir))


QUERIES = {f.__name__: f for f in (graph_degrees, graph_components, graph_loops, grid_prefix, grid_dilate, grid_distance, placement_rank, placement_dedupe, mesh_non_manifold, mesh_flipped, mesh_summary, mesh_dictionary, mesh_shells, mesh_t_junctions, grid_fill, grid_rectangles)}

SUPPLY = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000000 AS dst FROM lineitem)"
CELLS = "g AS (SELECT CAST(floor((p_partkey - 1) / 400) AS BIGINT) AS plate, CAST(floor((p_partkey - 1) / 20) AS BIGINT) % 20 AS r, (p_partkey - 1) % 20 AS c, p_brand IN ('Brand#11', 'Brand#1', 'Brand#23') AS blocked FROM part)"
KEY = "CAST(floor(CAST(embedding[{0}] AS DOUBLE) / CAST(0.2 AS DOUBLE) + 0.5) AS BIGINT) || ':' || CAST(floor(CAST(embedding[{1}] AS DOUBLE) / CAST(0.2 AS DOUBLE) + 0.5) AS BIGINT)"
TRIS = f"t AS (SELECT label AS mesh_id, vec_id AS tri, {KEY.format(1, 2)} AS ka, {KEY.format(3, 4)} AS kb, {KEY.format(5, 6)} AS kc FROM embeddings), e AS (SELECT mesh_id, tri, least(a, b) AS lo, greatest(a, b) AS hi, a < b AS f FROM (SELECT mesh_id, tri, ka AS a, kb AS b FROM t UNION ALL SELECT mesh_id, tri, kb, kc FROM t UNION ALL SELECT mesh_id, tri, kc, ka FROM t) WHERE a <> b)"
NON = "SELECT mesh_id, lo, hi, count(*) AS n FROM e GROUP BY ALL HAVING count(*) <> 2"
FLIP = "SELECT mesh_id, lo, hi, min(tri) AS tri_a, max(tri) AS tri_b FROM e GROUP BY mesh_id, lo, hi HAVING count(*) = 2 AND count(*) FILTER (WHERE f) <> 1 AND min(tri) <> max(tri)"
MM, BAL = "(p_size / lines / 2.0)", "((p_partkey % 10) / 10.0)"
LOW, HIGH = grid.LOW, grid.HIGH


def _settled(rounds: int) -> str:
    """Labels l0 (v, l) of links b (s, d) after so many rounds of the least label near and the label of the label: enough for these tables."""
    steps = [f"n{i} AS (SELECT a.v, least(a.l, coalesce(min(c.l), a.l)) AS l FROM l{i} a LEFT JOIN b ON b.s = a.v LEFT JOIN l{i} c ON c.v = b.d GROUP BY a.v, a.l), l{i + 1} AS (SELECT n.v, least(n.l, coalesce(o.l, n.l)) AS l FROM n{i} n LEFT JOIN n{i} o ON o.v = n.l)" for i in range(rounds)]
    return ", ".join(steps)


ORACLES = {
    "graph_components": f"""WITH e AS (SELECT DISTINCT l_partkey AS s, l_suppkey + 1000000000 AS d FROM lineitem), b AS (SELECT s, d FROM e UNION ALL SELECT d, s FROM e), l0 AS (SELECT DISTINCT s AS v, s AS l FROM b), {_settled(6)}
SELECT v AS vid, l AS component FROM l6""",
    "mesh_shells": f"""WITH {TRIS}, p AS (SELECT mesh_id, lo, hi, min(tri) AS first, count(*) AS n FROM e GROUP BY ALL), t2 AS (SELECT e.mesh_id, e.tri, first, n FROM e JOIN p USING (mesh_id, lo, hi)),
b AS (SELECT DISTINCT tri AS s, first AS d FROM t2 UNION SELECT DISTINCT first, tri FROM t2), l0 AS (SELECT DISTINCT s AS v, s AS l FROM b), {_settled(8)},
r AS (SELECT mesh_id, l AS shell, max(n <> 2) AS open FROM t2 JOIN l8 ON v = tri GROUP BY ALL) SELECT mesh_id, count(*) AS shells, count(*) FILTER (WHERE open) AS open_shells FROM r GROUP BY mesh_id""",
    "placement_dedupe": """WITH RECURSIVE i AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_size) AS k FROM part),
f AS (SELECT p_brand, k, [p_size] AS last, 1 AS kept FROM i WHERE k = 1 UNION ALL
  SELECT f.p_brand, i.k, CASE WHEN u THEN f.last ELSE list_append(f.last, i.p_size)[-3:] END, f.kept + CASE WHEN u THEN 0 ELSE 1 END
  FROM (SELECT f.p_brand, f.k, f.last, f.kept, i.p_size AS x, len(list_filter(f.last, lambda y: abs(y - i.p_size) <= 2)) > 0 AS u FROM f JOIN i ON i.p_brand = f.p_brand AND i.k = f.k + 1) f JOIN i ON i.p_brand = f.p_brand AND i.k = f.k + 1)
SELECT p_brand, CAST(max_by(kept, k) AS INTEGER) AS kept, CAST(max(k) AS INTEGER) AS items FROM f GROUP BY p_brand""",
    "graph_degrees": f"WITH {SUPPLY} SELECT vid, count(*) AS degree FROM (SELECT src AS vid FROM e UNION ALL SELECT dst FROM e) GROUP BY vid",
    "graph_loops": """WITH RECURSIVE e AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst, a.n_nationkey * 100 + b.n_nationkey AS eid, CAST(a.n_nationkey * 7 % 11 + 1 AS DOUBLE) AS length FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 OR b.n_nationkey = a.n_nationkey + 3),
arcs AS (SELECT src, dst, eid, length FROM e UNION ALL SELECT dst, src, eid, length FROM e),
r AS (SELECT src AS s, dst AS t, [src, dst] AS seen, [eid] AS eids, length, false AS done FROM arcs WHERE dst > src
  UNION ALL SELECT r.s, a.dst, list_append(seen, a.dst), list_append(eids, a.eid), r.length + a.length, a.dst = r.s FROM r JOIN arcs a ON a.src = r.t
  WHERE NOT done AND len(eids) < 6 AND NOT list_contains(eids, a.eid) AND a.dst >= r.s AND r.length + a.length <= 60 AND (a.dst = r.s OR NOT list_contains(seen, a.dst)))
SELECT array_to_string(list_sort(eids), ',') AS loop_key, round(min(length), 6) AS length, CAST(len(any_value(eids)) AS INTEGER) AS edges FROM r WHERE done AND length >= 4 GROUP BY list_sort(eids)""",
    "grid_prefix": f"WITH {CELLS} SELECT a.plate, a.r, a.c, CAST(count(*) FILTER (WHERE b.blocked) AS BIGINT) AS total FROM g a JOIN g b ON a.plate = b.plate AND b.r <= a.r AND b.c <= a.c GROUP BY ALL",
    "grid_dilate": f"WITH {CELLS} SELECT a.plate, a.r, a.c, CAST(bool_or(b.blocked) AS INTEGER) AS near FROM g a JOIN g b ON a.plate = b.plate AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL",
    "grid_distance": f"WITH {CELLS} SELECT a.plate, a.r, a.c, coalesce(min(greatest(abs(a.r - b.r), abs(a.c - b.c))), -1) AS dist FROM g a LEFT JOIN (SELECT * FROM g WHERE blocked) b ON a.plate = b.plate GROUP BY ALL",
    "placement_rank": f"""WITH x AS (SELECT p_brand, p_partkey, CAST(lines AS INTEGER) AS lines, CAST({MM} AS DOUBLE) AS mm, CAST({BAL} AS DOUBLE) AS bal, CAST((p_size % 5) / 4.0 AS DOUBLE) AS outside, CAST((p_partkey % 7) / 6.0 AS DOUBLE) AS tr, CAST((p_partkey % 3) / 2.0 AS DOUBLE) AS tx FROM part, range(1, 5) l(lines)),
y AS (SELECT *, CASE WHEN bal >= 0.7 THEN 1 ELSE bal / CAST(0.7 AS DOUBLE) END AS w, [0.0, 0.75, 0.25, 0.0][lines] AS damp FROM x),
z AS (SELECT p_brand, p_partkey, lines, round((w + (1 - w) * (CASE WHEN lines = 1 THEN 0 ELSE damp END)) * (0.25 + 0.75 * CAST(outside AS DOUBLE)) * CAST([1, 1, 0.94, 0.91][lines] AS DOUBLE)
  * CASE WHEN mm <= 2 THEN 0 WHEN mm < {LOW!r} THEN pow((mm - 2) / ({LOW!r}::DOUBLE - 2), 3) * CAST(0.6 AS DOUBLE) WHEN mm <= {HIGH!r} THEN 0.6 + CAST(0.65 AS DOUBLE) * (mm - {LOW!r}::DOUBLE) / ({HIGH!r}::DOUBLE - {LOW!r}::DOUBLE) WHEN mm <= {HIGH + LOW - 2!r} THEN 1.25 * (1 - (mm - {HIGH!r}::DOUBLE) / ({LOW!r}::DOUBLE - 2)) ELSE 0 END
  * (0.92 + CAST(0.08 AS DOUBLE) * tr) * (0.96 + CAST(0.04 AS DOUBLE) * tx), 9) AS score FROM y),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey, lines) AS INTEGER) AS rank FROM z) SELECT * FROM r WHERE rank <= 3""",
    "mesh_non_manifold": f"WITH {TRIS} {NON}",
    "mesh_flipped": f"WITH {TRIS} {FLIP}",
    "mesh_summary": f"""WITH {TRIS}, n AS ({NON}), fl AS ({FLIP}), v AS (SELECT mesh_id, count(DISTINCT k) AS vertices FROM (SELECT mesh_id, unnest([ka, kb, kc]) AS k FROM t) GROUP BY mesh_id)
SELECT mesh_id, count(*) AS triangles, count(*) FILTER (WHERE ka = kb OR kb = kc OR kc = ka) AS degenerate, any_value(vertices) AS vertices, (SELECT count(*) FROM n WHERE n.mesh_id = t.mesh_id) AS non_manifold, (SELECT count(*) FROM fl WHERE fl.mesh_id = t.mesh_id) AS flipped FROM t JOIN v USING (mesh_id) GROUP BY mesh_id""",
    "mesh_dictionary": f"""WITH {TRIS}, u AS (SELECT mesh_id, key, min((tri, corner)) AS place FROM (SELECT mesh_id, tri, 0 AS corner, ka AS key FROM t UNION ALL SELECT mesh_id, tri, 1, kb FROM t UNION ALL SELECT mesh_id, tri, 2, kc FROM t) GROUP BY ALL)
SELECT mesh_id, key, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY place) - 1 AS INTEGER) AS idx FROM u""",
    "mesh_t_junctions": f"""WITH q AS (SELECT label AS mesh_id, vec_id, {", ".join(f"floor(CAST(embedding[{i + 1}] AS DOUBLE) / CAST(0.1 AS DOUBLE) + 0.5) / 10 AS q{i}" for i in range(4))} FROM embeddings),
p AS (SELECT a.mesh_id, a.vec_id AS v, b.vec_id AS e, sqrt((b.q2 - b.q0) ** 2 + (b.q3 - b.q1) ** 2) AS run, (a.q0 - b.q0) * (b.q2 - b.q0) + (a.q1 - b.q1) * (b.q3 - b.q1) AS dot, abs((a.q0 - b.q0) * (b.q3 - b.q1) - (a.q1 - b.q1) * (b.q2 - b.q0)) AS side FROM q a JOIN q b ON a.mesh_id = b.mesh_id)
SELECT mesh_id, v, e FROM p WHERE run > 0 AND dot / run > 0.0001 AND dot / run < run - 0.0001 AND side / run <= 0.0001""",
    "grid_fill": """SELECT p_partkey AS plate, r, c FROM part, range(5) a(r), range(6) b(c)
WHERE c + 0.5 >= 0.2 AND c + 0.5 < p_size % 7 + 1.3 AND r + 0.5 < p_size % 5 + 1.6""",
    "grid_rectangles": f"""WITH {CELLS},
h AS (SELECT a.plate, a.r AS r1, b.r AS r2, a.c FROM g a JOIN g b ON a.plate = b.plate AND a.c = b.c AND b.r >= a.r JOIN g m ON m.plate = a.plate AND m.c = a.c AND m.r BETWEEN a.r AND b.r GROUP BY ALL HAVING NOT bool_or(m.blocked)),
i AS (SELECT *, c - row_number() OVER (PARTITION BY plate, r1, r2 ORDER BY c) AS k FROM h), x AS (SELECT plate, r1, min(c) AS c1, r2, max(c) AS c2 FROM i GROUP BY plate, r1, r2, k)
SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.plate = x.plate AND y.r1 <= x.r1 AND y.r2 >= x.r2 AND y.c1 <= x.c1 AND y.c2 >= x.c2 AND (y.r2 - y.r1 > x.r2 - x.r1))""",
}
