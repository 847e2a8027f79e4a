"""Documents, names, tags, model reports, rings and anchors over the driver's tables (SRC02-04, SRC10, SNK07, PRJ10, PRJ14-18, FLT04-06, FLT12, AGG13, AGG17, STR17, STR19, MTH05, ARR01-05, SET06, STM05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, models
from .search import table

#: Patterns of labels and the metres they name, in order.
HINTS = (("^s", 1500.0), ("brushed|anodized", 2500.0), ("tin$", 3500.0))


def document_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    node = F.struct(F.col("c_acctbal").alias("lat"), (-F.col("c_acctbal")).alias("lon"))
    stats = F.when(k % 2 == 0, F.struct(F.col("c_acctbal").alias("lengthMetres"), F.col("c_nationkey").alias("segmentCount"), F.lit(1).alias("variantSectionCount")))
    layout = F.struct(F.col("c_mktsegment").alias("id"), F.col("c_name").alias("name"), F.when(k % 5 > 0, F.array(node, node)).alias("nodes"), stats.alias("stats"))
    docs = c.select(k.alias("track_id"), F.col("c_name").alias("name"), F.when(k % 3 > 0, F.struct(F.array("c_mktsegment").alias("osmVenueNames"))).alias("names"), F.when(k % 7 > 0, F.array(layout)).alias("layouts"))
    d = documents.whole_documents(docs)
    first = F.get("layouts", F.lit(0))
    return d.select("track_id", F.size("layouts").alias("layouts"), F.coalesce(F.size(first["nodes"]), F.lit(-1)).alias("nodes"), F.coalesce(first["stats"]["lengthMetres"], F.lit(-1.0)).alias("metres"), F.size("venue_names").alias("names"), "selected")


def known_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    lat = F.when(F.col("c_acctbal") < 0, float("nan")).when(F.col("c_nationkey") == 3, float("inf")).when(F.col("c_nationkey") != 4, F.col("c_acctbal"))
    return documents.index_positions(c.select(F.col("c_custkey").alias("wikidataId"), F.col("c_name").alias("label"), lat.alias("lat"), F.col("c_nationkey").cast("double").alias("lon")))


def geometry_or_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("track_id")).agg(F.count("*").alias("layouts"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_name").alias("name"))
    return documents.geometry_or_error(asked, docs).select("track_id", F.coalesce("layouts", F.lit(0)).alias("layouts"), "error")


def layout_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as layouts; its price in millions of thirds is the place asked for."""
    line = F.struct("l_linenumber", F.col("l_partkey").alias("k"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("name"), F.round(F.floor("l_extendedprice") + 0.03, 2).alias("metres"), F.col("l_linenumber").alias("variants"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("layouts"))
    rows = rows.join(table(spark, sf_dir, "orders"), rows.l_orderkey == F.col("o_orderkey")).select("l_orderkey", "layouts", (F.col("o_custkey") % 17 / 2 - 1).alias("index"))
    p = documents.picker(rows)
    return p.select("l_orderkey", F.col("hidden").cast("int").alias("hidden"), "hint", "selected", F.array_join(F.transform("options", lambda o: F.concat(o["value"], F.lit(":"), o["label"], F.lit(":"), o["selected"].cast("int"))), "|").alias("options"))


def layout_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = documents.way_names(F.col("p_name"), F.array(F.concat(F.lit(" "), F.col("p_type")), F.col("p_name"), F.lit(None).cast("string"), F.concat("p_brand", F.lit(" Short Circuit")), F.lit("  ")))
    rows = p.select("p_partkey", names.alias("n"))
    return rows.select("p_partkey", F.array_join(F.transform("n", lambda e: F.concat(e["source"], F.lit(":"), e["name"])), "|").alias("names"), F.size(F.filter("n", lambda e: documents.layout_like(e["name"]))).alias("alike"))


def layout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    entries = documents.way_names(F.concat("c_mktsegment", F.when(F.col("c_acctbal") > 0, " Circuit").otherwise(" Street")), F.array(F.concat(F.substring("c_mktsegment", 1, 1), F.lit(" oval")), F.lit("Paddock")))
    g = documents.name_groups(c.select(F.col("c_nationkey").alias("track"), F.col("c_custkey").alias("way_id"), entries.alias("entries")))
    return g.select("track", "name", F.size("ways").alias("ways"), F.array_min("ways").alias("first"), "rank")


def length_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(m).alias("metres")) for p, m in HINTS])
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(documents.length_target(F.col("p_type"), hints), F.lit(-1.0)).alias("metres"))


def circuit_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ways, lines as members of relations that are circuits of one id or not."""
    flag = F.when(F.col("l_returnflag") == "R", "circuit").otherwise("route")
    relations = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.create_map(F.lit("type"), flag, F.lit("wikidata"), F.concat(F.lit("Q"), F.col("l_linenumber"))).alias("tags"))
    members = documents.circuit_relations(relations, F.lit("Q2"))
    o = table(spark, sf_dir, "orders")
    ways = o.select(F.col("o_orderkey").alias("way_id"), F.when(F.col("o_orderstatus") == "F", " Raceway").alias("highway"), F.when(F.col("o_orderpriority") < "3", "MOTOR").otherwise("kart").alias("sport"))
    return documents.circuit_ways(ways, members).select("way_id", F.col("by_relation_only").cast("int").alias("by_relation_only"))


def first_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    parts = line.select(F.col("l_suppkey").alias("part"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), F.col("l_partkey").alias("way_id"))
    members = table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("way_id"))
    found, missing = documents.first_ways(parts, members)
    return found.select("way_id", "part", "place").unionByName(missing.select("way_id", F.lit(-1).cast("long").alias("part"), F.lit(-1).cast("long").alias("place")))


def valid_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cached = o.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("generation"))
    return documents.still_valid(cached, o.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("generation")), "o_custkey").select("o_orderkey", "generation")


def listed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.of_values(table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey"), "c_mktsegment", ["BUILDING", "MACHINERY", "BUILDING", "none"])


def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.lit(None).cast("struct<lat:double,lon:double>")
    ways = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("wayId"), none.alias("fromNode"), none.alias("toNode")))).alias("ways"))
    layout = lambda name: F.struct(name.alias("name"), F.col("ways"))
    rows = r.join(ways, r.r_regionkey == F.col("n_regionkey")).select(F.concat(F.lit("Q"), "r_regionkey").alias("track_id"), F.col("r_name").alias("name"), F.array(layout(F.lit("  ")), layout(F.concat(F.lit(" "), "r_name"))).alias("layouts"), F.array().cast("array<struct<wayId:int,reason:string>>").alias("excluded"))
    return documents.export_document(rows).select("track_id", "document")


def text_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", models.text_rank(F.col("c_acctbal") / 1000).alias("rank"))


def model_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("place"), (F.col("l_orderkey") % 3).alias("base"), F.when(F.col("l_orderkey") % 2 == 0, 2).alias("second"))
    return line.groupBy("l_orderkey", models.part_of(F.col("place"), F.col("base"), F.col("second")).alias("part")).agg(F.count("*").alias("triangles"))


def part_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's customers as a model's triangles, balances as defects."""
    c = table(spark, sf_dir, "customer")
    part = F.when(F.col("c_mktsegment") < "C", "base").when(F.col("c_mktsegment") < "H", "track")
    hits = {n: F.count_if(F.col("c_acctbal") < low) for n, low in zip(models.COUNTS, (-900, -950, 0, -500, -980, -990))}
    counts = c.select(F.col("c_nationkey").alias("model"), part.alias("part"), "c_acctbal").where("part is not null").groupBy("model", "part").agg(F.count("*").alias("triangles"), *[h.alias(n) for n, h in hits.items()])
    report = models.part_report(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("model")), counts)
    return report.select("model", "part", "triangles", F.col("ok").cast("int").alias("ok"), models.part_failed().cast("int").alias("failed"))


def sweep_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of nations' models that fail, and the nations of a region that is not built."""
    n = table(spark, sf_dir, "nation")
    report = part_reports(spark, sf_dir)
    counts = report.select("model", "part", *[(F.col("failed") if c == "crossings" else F.lit(0)).alias(c) for c in models.COUNTS])
    builds = n.select(F.col("n_nationkey").alias("model"), F.when(F.col("n_regionkey") == 2, F.concat(F.lit("no base of "), "n_name")).alias("error"))
    return models.sweep_failures(builds, counts).select("model", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("error", F.lit("")).alias("error"))


def edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = (F.get("embedding", F.lit(i)).cast("double") for i in range(4))
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", models.edge_key(a, b, c, d).alias("edge"))


def outline_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as points: flags that repeat are one point, prices that are not numbers none."""
    x = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(3.0)
    point = F.struct("l_linenumber", "l_partkey", x.alias("x"), F.when(F.col("l_quantity") == 7, float("nan")).otherwise((F.col("l_linenumber") / 3).cast("int").cast("double")).alias("y"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("p"))
    far = lambda n: F.struct(F.lit(float(n)).alias("x"), F.lit(100.0 * n).alias("y"))
    points = F.concat(F.array(far(9), far(9), far(8), far(7)), F.transform("p", lambda q: F.struct(q["x"], q["y"])), F.array(far(9)))
    return rows.select("l_orderkey", F.size(models.ring(points)).alias("points"))


def flat_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine numbers to triangles and back, and the middle vertex's y."""
    v = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.transform(F.slice("embedding", 1, 18), lambda x: x.cast("double")).alias("v"))
    t = models.triangles_of(F.col("v"))
    return v.select("vec_id", F.size(t).alias("triangles"), F.round(F.element_at(F.get(t, F.lit(1)), 2)["y"], 6).alias("y"), (models.flattened(t) == F.col("v")).cast("int").alias("same"))


def best_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("deg"))
    wide = F.col("deg") % 180 == 0
    w, h = F.col("p_size"), F.lit(25)
    y = F.when((F.col("p_partkey") + F.col("deg") / 90) % 4 != 1, (F.col("p_partkey") % 5 - 2) * F.when(F.col("deg") < 180, 1).otherwise(-1))
    rows = p.select(F.col("p_partkey").alias("track"), "deg", F.when(wide, w).otherwise(h).alias("width"), F.when(wide, h).otherwise(w).alias("height"), y.alias("text_y"), F.lit(0).alias("centre_y"))
    return models.best_turn(rows)


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as nodes on a line, in order of their numbers."""
    node = F.struct((F.col("l_linenumber") / 10).alias("lat"), F.lit(5.0).alias("lon"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(node)).alias("nodes"), F.count("*").alias("n"))


def anchored_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes between two anchors (either may be missing or no node), and the way round that lies nearer the south."""
    at = lambda k: F.struct((F.lit(k) / 10).alias("lat"), F.lit(5.0).alias("lon"))
    none = F.lit(None).cast("struct<lat:double,lon:double>")
    rows = _chains(spark, sf_dir)
    part = models.between_anchors(F.col("nodes"), F.when(F.col("l_orderkey") % 3 > 0, at(2)).otherwise(none), F.when(F.col("l_orderkey") % 2 > 0, at(4)).otherwise(none))
    rows = rows.select("l_orderkey", part.alias("part"), models.turned_to(F.col("nodes"), at(5), at(2)).alias("turned"))
    return rows.select("l_orderkey", F.coalesce(F.size("part"), F.lit(-1)).alias("nodes"), F.coalesce(F.get("part", F.lit(0))["lat"], F.lit(-1.0)).alias("first"), F.get("turned", F.lit(0))["lat"].alias("begins"))


def trimmed_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's nodes, and a way that crosses them at the third."""
    at = lambda k, lon=5.0: F.struct((F.lit(k) / 10).alias("lat"), F.lit(lon).alias("lon"))
    rows = _chains(spark, sf_dir).select("l_orderkey", F.col("nodes").alias("a"), F.lit(None).cast("struct<lat:double,lon:double>").alias("a_from"), F.array(at(3, 4.0), at(3), at(3, 6.0)).alias("b"))
    t = models.auto_trim(rows)
    return t.select("l_orderkey", F.coalesce("a_to.lat", F.lit(-1.0)).alias("a_to"), F.coalesce("b_from.lat", F.lit(-1.0)).alias("b_from"))


QUERIES = {f.__name__: f for f in (document_shapes, known_positions, geometry_or_error, layout_picker, layout_names, layout_groups, length_targets, circuit_ways, first_ways, valid_cache, listed_segments, export_documents, text_ranks, model_parts, part_reports, sweep_failures, edge_keys, outline_rings, flat_triangles, best_turns, anchored_slices, trimmed_ways)}

LAYOUT_RE = documents.LAYOUT.replace("(?iu)", "")
KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
LINES = "n AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS k FROM lineitem GROUP BY l_orderkey)"
ORACLES = {
    "document_shapes": """SELECT c_custkey AS track_id, CAST(c_custkey % 7 > 0 AS INTEGER) AS layouts, CASE WHEN c_custkey % 7 = 0 THEN -1 WHEN c_custkey % 5 > 0 THEN 2 ELSE 0 END AS nodes,
CASE WHEN c_custkey % 7 = 0 THEN -1.0::DOUBLE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0.0::DOUBLE END AS metres, CAST(c_custkey % 3 > 0 AS INTEGER) AS names, 0 AS selected FROM customer""",
    "known_positions": "SELECT c_custkey AS wikidataId, c_name AS label, c_acctbal AS lat, CAST(c_nationkey AS DOUBLE) AS lon FROM customer WHERE c_acctbal >= 0 AND c_nationkey NOT IN (3, 4)",
    "geometry_or_error": "SELECT c_custkey AS track_id, coalesce(n, 0) AS layouts, CASE WHEN n IS NULL THEN 'No geometry for ' || c_name END AS error FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON o_custkey = c_custkey",
    "layout_picker": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, floor(l_extendedprice) + 0.03 AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, nullif(l_returnflag, 'N') NULLS FIRST, l_extendedprice) - 1 AS i FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, CAST(min(l_linenumber) AS INTEGER) AS v, o_custkey % 17 / 2::DOUBLE - 1 AS x FROM l JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_custkey),
s AS (SELECT *, CAST(CASE WHEN x = floor(x) THEN greatest(least(x, n - 1), 0) ELSE 0 END AS INTEGER) AS sel FROM g),
o AS (SELECT l.l_orderkey, string_agg(i || ':' || CASE WHEN l_returnflag = 'N' THEN 'Layout ' || (i + 1) ELSE l_returnflag END || ' - ' || printf('%.1f', round(m / 1000, 1)) || ' km:' || CAST(i = sel AS INTEGER), '|' ORDER BY i) AS options FROM l JOIN s USING (l_orderkey) GROUP BY l.l_orderkey)
SELECT l_orderkey, CAST(n <= 1 AS INTEGER) AS hidden, CASE WHEN n <= 1 THEN '' WHEN v = 1 THEN 'Select the alternate section to use for the circuit.' ELSE 'Select one of ' || n || ' fork-based layout combinations.' END AS hint, sel AS selected, CASE WHEN n <= 1 THEN '' ELSE options END AS options FROM s JOIN o USING (l_orderkey)""",
    "layout_names": f"""SELECT p_partkey, 'way:' || trim(p_name) || CASE WHEN trim(p_type) <> trim(p_name) THEN '|relation:' || trim(p_type) ELSE '' END || '|relation:' || p_brand || ' Short Circuit' AS names,
CAST(regexp_matches(p_name, '{LAYOUT_RE}', 'i') AS INTEGER) + CASE WHEN trim(p_type) <> trim(p_name) THEN CAST(regexp_matches(p_type, '{LAYOUT_RE}', 'i') AS INTEGER) ELSE 0 END + 1 AS alike FROM part""",
    "layout_groups": """WITH e AS (SELECT c_nationkey AS track, c_custkey AS way_id, c_mktsegment || ' Circuit' AS name, 1 AS source FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_nationkey, c_custkey, substr(c_mktsegment, 1, 1) || ' oval', 0 FROM customer),
g AS (SELECT track, name, CAST(count(*) AS INTEGER) AS ways, min(way_id) AS first, max(source) AS rank FROM e GROUP BY ALL) SELECT * FROM g WHERE track IN (SELECT track FROM g GROUP BY track HAVING count(*) >= 2)""",
    "length_targets": f"SELECT p_partkey, CAST(CASE {' '.join(f'WHEN regexp_matches({KEY.format(chr(112) + chr(95) + chr(116) + chr(121) + chr(112) + chr(101))}, {p!r}) THEN {m}' for p, m in HINTS)} ELSE -1 END AS DOUBLE) AS metres FROM part",
    "circuit_ways": """WITH m AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2), w AS (SELECT o_orderkey, o_orderstatus = 'F' AND o_orderpriority < '3' AS tagged, o_orderkey IN (SELECT l_orderkey FROM m) AS member FROM orders)
SELECT o_orderkey AS way_id, CAST(member AND NOT tagged AS INTEGER) AS by_relation_only FROM w WHERE member OR tagged""",
    "first_ways": """WITH p AS (SELECT l_partkey AS way_id, l_suppkey AS part, l_orderkey * 8 + l_linenumber AS place FROM lineitem), f AS (SELECT way_id, part, place, row_number() OVER (PARTITION BY way_id ORDER BY part, place) AS k FROM p)
SELECT way_id, part, place FROM f WHERE k = 1 UNION ALL SELECT DISTINCT user_id * 3, -1, -1 FROM events WHERE user_id * 3 NOT IN (SELECT way_id FROM p)""",
    "valid_cache": "SELECT o_orderkey, o_orderpriority AS generation FROM orders o WHERE o_orderpriority = (SELECT max(o_orderpriority) FROM orders p WHERE p.o_custkey = o.o_custkey)",
    "listed_segments": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment IN (VALUES ('BUILDING'), ('MACHINERY'), ('none'))",
    "export_documents": """WITH w AS (SELECT n_regionkey, '{"ways":[' || string_agg('{"wayId":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || ']}' AS ways FROM nation GROUP BY n_regionkey)
SELECT 'Q' || r_regionkey AS track_id, '{"trackId":"Q' || r_regionkey || '","name":"' || r_name || '","layouts":{"Untitled":' || ways || ',"' || r_name || '":' || ways || '}}' AS document FROM region JOIN w ON n_regionkey = r_regionkey""",
    "text_ranks": "SELECT c_custkey, CAST(CASE WHEN trunc(c_acctbal / 1000) >= 1 THEN trunc(c_acctbal / 1000) ELSE 1 END AS BIGINT) AS rank FROM customer",
    "model_parts": "SELECT l_orderkey, CASE WHEN l_linenumber <= l_orderkey % 3 THEN 'base' WHEN l_orderkey % 2 = 0 AND l_linenumber <= l_orderkey % 3 + 2 THEN 'secondary' ELSE 'track' END AS part, count(*) AS triangles FROM lineitem GROUP BY ALL",
    "part_reports": """WITH c AS (SELECT c_nationkey AS model, CASE WHEN c_mktsegment < 'C' THEN 'base' WHEN c_mktsegment < 'H' THEN 'track' END AS part, c_acctbal AS b FROM customer),
p AS (SELECT n_nationkey AS model, part FROM nation, (VALUES ('base'), ('secondary'), ('track')) v(part)), r AS (SELECT p.model, p.part, count(b) AS triangles, count(*) FILTER (WHERE b < -900) AS e, count(*) FILTER (WHERE b < -950) AS d, count(*) FILTER (WHERE b < 0) AS t FROM p LEFT JOIN c ON c.model = p.model AND c.part = p.part GROUP BY ALL)
SELECT model, part, triangles, CAST(max(e + d) OVER (PARTITION BY model) = 0 AS INTEGER) AS ok, CAST(t > 0 AS INTEGER) AS failed FROM r""",
    "sweep_failures": """WITH c AS (SELECT DISTINCT c_nationkey AS model, CASE WHEN c_mktsegment < 'C' THEN 'base' WHEN c_mktsegment < 'H' THEN 'track' END AS part FROM customer WHERE c_acctbal < 0)
SELECT model, part, '' AS error FROM c JOIN nation ON n_nationkey = model WHERE part IS NOT NULL AND n_regionkey <> 2 UNION ALL SELECT n_nationkey, '', 'no base of ' || n_name FROM nation WHERE n_regionkey = 2""",
    "edge_keys": """WITH k AS (SELECT vec_id, [CAST(floor(CAST(embedding[1] AS DOUBLE) / 0.01::DOUBLE + 0.5) AS BIGINT), CAST(floor(CAST(embedding[2] AS DOUBLE) / 0.01::DOUBLE + 0.5) AS BIGINT)] AS a, [CAST(floor(CAST(embedding[3] AS DOUBLE) / 0.01::DOUBLE + 0.5) AS BIGINT), CAST(floor(CAST(embedding[4] AS DOUBLE) / 0.01::DOUBLE + 0.5) AS BIGINT)] AS b FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, least(a, b)[1] || ',' || least(a, b)[2] || '|' || greatest(a, b)[1] || ',' || greatest(a, b)[2] AS edge FROM k""",
    "outline_rings": """WITH p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS i, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS x, l_linenumber // 3 AS y FROM lineitem WHERE l_quantity <> 7),
d AS (SELECT l_orderkey, x = lag(x) OVER w AND y = lag(y) OVER w AS again FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY i))
SELECT l_orderkey, CAST(3 + count(d.l_orderkey) FILTER (WHERE again IS NOT TRUE) AS INTEGER) AS points FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN d USING (l_orderkey) GROUP BY l_orderkey""",
    "flat_triangles": "SELECT vec_id, CAST(len(embedding[:18]) // 9 AS INTEGER) AS triangles, round(CAST(embedding[14] AS DOUBLE), 6) AS y, 1 AS same FROM embeddings WHERE embedding IS NOT NULL",
    "best_turns": """WITH t AS (SELECT p_partkey AS track, deg, CASE WHEN deg % 180 = 0 THEN p_size >= 25 ELSE 25 >= p_size END AS wide, CASE WHEN (p_partkey + deg // 90) % 4 <> 1 THEN (p_partkey % 5 - 2) * CASE WHEN deg < 180 THEN 1 ELSE -1 END END AS y FROM part, (VALUES (0), (90), (180), (270)) v(deg)),
s AS (SELECT track, deg, CASE WHEN wide THEN 1000 ELSE 0 END + CASE WHEN y < 0 THEN 100 ELSE 0 END AS score FROM t) SELECT track, deg, score FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, deg) AS k FROM s) WHERE k = 1""",
    "anchored_slices": f"""WITH {LINES}, a AS (SELECT l_orderkey, k, CASE WHEN l_orderkey % 3 > 0 THEN list_position(k, 2) ELSE 1 END AS i, CASE WHEN l_orderkey % 2 > 0 THEN list_position(k, 4) ELSE len(k) END AS j FROM n)
SELECT l_orderkey, CAST(CASE WHEN i IS NULL OR j IS NULL OR i = 0 OR j = 0 OR j < i THEN -1 ELSE j - i + 1 END AS INTEGER) AS nodes, CASE WHEN i IS NULL OR j IS NULL OR i = 0 OR j = 0 OR j < i THEN -1 ELSE k[i] / 10 END::DOUBLE AS first,
CASE WHEN abs(k[1] - 2) + abs(k[-1] - 5) < abs(k[1] - 5) + abs(k[-1] - 2) THEN k[-1] ELSE k[1] END / 10::DOUBLE AS begins FROM a""",
    "trimmed_ways": f"""WITH {LINES}, a AS (SELECT *, list_position(k, 3) AS i FROM n) SELECT l_orderkey, CASE WHEN i > 1 AND i < len(k) THEN 0.3 ELSE -1 END::DOUBLE AS a_to, CASE WHEN i > 0 THEN 0.3 ELSE -1 END::DOUBLE AS b_from FROM a""",
}
