"""Golden values of the reference semantics on small rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.functions import text as T
from meridian.operators import chains, graph, grid, mesh, search


def series(spark, values):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "chain long, idx long, v double")
    w = Window.partitionBy("chain")
    return [r[0] for r in df.select("idx", geo.smooth(F.col("v"), w, w.orderBy("idx")).alias("s")).orderBy("idx").select("s").collect()]


def test_smoothing(spark):
    got = series(spark, [0, 0, 0, 60, 60, 60])
    assert [round(got[i], 9) for i in (0, 3, 4)] == [5.25, 54.75, 60]
    assert [round(x, 9) for x in series(spark, [40, 0, 0, 0])] == [33, 3.5, 0, 3.5]
    assert series(spark, [7, 9]) == [7, 9]


def test_tile_height(spark):
    assert spark.range(1).select(geo.tile_height(F.lit(129), F.lit(144), F.lit(0))).first()[0] == 400


def test_text_forms(spark):
    row = spark.createDataFrame([("Nürburgring & Spa-Francorchamps ",)], "v string").select(T.search_text(F.col("v")), T.slug(F.col("v")), T.name_key(F.col("v"))).first()
    assert tuple(row) == ("nurburgring and spa francorchamps", "nurburgring-spa-francorchamps", "n rburgring spa francorchamps")


def test_text_forms_of_other_letters(spark):
    rows = [("Việt ế ﬁn Ａ ①",), ("São Tomé",), (None,), ("e\u0301 ½",), ("Ⅳ ½ x² ª",)]
    got = spark.createDataFrame(rows, "v string").select(T.search_text(F.col("v")), T.slug(F.col("v"))).collect()
    assert [r[0] for r in got] == ["viet e fin a 1", "sao tome", "", "e 1 2", "iv 1 2 x2 a"] and got[0][1] == "viet-e-fin-a-1"
    each = spark.createDataFrame([(["Ａ b", "Ü", ""],), (["x", "X"],), (None,)], "v array<string>").select(T.search_texts(F.col("v"))).collect()
    assert [r[0] for r in each] == [["a b", "u"], ["x"], None]


def test_index_of_odd_names(spark):
    rows = [
        ("a", "Q123", ["Spa  Park"], None, "São Tomé", "Sao Tome"), ("b", "", ["Monza", "M"], None, "x", "y"), ("c", "Q1", ["q2"], None, None, None), ("d", " ", [], None, None, None),
        ("e", "A & A ring", None, " ", None, "y"), ("f", None, None, "GP", "x", "y"), ("g", "Ế", [], None, "x", ""),
    ]
    venues = spark.createDataFrame([(*r, None, 1.0, 2.0) for r in rows], "venue_id string, label string, aliases array<string>, short_name string, city string, country string, type string, lat double, lon double")
    got = {r.venue_id: r for r in search.build_index(venues).collect()}
    assert {k: r["name"] for k, r in got.items()} == {"a": "Spa Park - São Tomé", "b": "Monza - x, y", "e": "A & A ring - y", "g": "Ế - x"}
    assert got["a"].label_words == 1 and got["b"].label_words == 0 and got["e"].label_words == 3 and got["e"].n_label == "a and a ring" and got["g"].tokens == ["e", "x"]


def test_retry_delay(spark):
    rows = spark.createDataFrame([("please wait 3 minutes",), ("try again in 3 minutes",), ("soon",)], "b string").select(T.retry_delay_seconds(F.col("b"))).collect()
    assert [r[0] for r in rows] == [180, None, None]


def test_rank_prefers_exact_label(spark):
    rows = [("a", "Spa", ["Ardennes"], None, "Stavelot", "Belgium", "track", 1.0, 2.0), ("b", "Spa Club", [], None, "Spa", "Belgium", "track", 1.0, 2.0), ("c", "Q123", [], None, "Spa", "Belgium", "track", 1.0, 2.0), ("d", "Far", [], None, None, None, None, float("nan"), 2.0)]
    venues = spark.createDataFrame(rows, "venue_id string, label string, aliases array<string>, short_name string, city string, country string, type string, lat double, lon double")
    got = search.rank(search.build_index(venues), spark.createDataFrame([("spa",)], "query string")).orderBy(F.desc("rank_score")).collect()
    assert [(r.venue_id, r.match_category) for r in got] == [("a", "exact-label"), ("b", "exact-city")]


def test_fold_keeps_far_nodes(spark):
    df = spark.createDataFrame([(0, i, v, 0.0) for i, v in enumerate((0.0, 0.4, 0.8, 1.2, 1.3))], "chain long, idx long, lat double, lon double")
    kept = chains.drop_near_duplicates(chains.collect(df), 0.7).select("kept.idx").first()[0]
    assert kept == [0, 2]


def test_loops_and_components(spark):
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (2, 1, 2, 1.0), (3, 2, 0, 1.0), (4, 2, 3, 1.0), (5, 3, 0, 1.0), (6, 9, 8, 1.0)], "eid long, src long, dst long, length double")
    assert {r.loop_key for r in graph.loops(edges, 5).collect()} == {"1,2,3", "3,4,5", "1,2,4,5"}
    assert {(r.vid, r.component) for r in graph.components(edges).collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (8, 8), (9, 8)}


def test_size_window_is_continuous(spark):
    at = lambda x: spark.range(1).select(grid.size_window(F.lit(float(x)))).first()[0]
    assert at(2) == 0 and abs(at(grid.LOW - 1e-9) - 0.6) < 1e-6 and abs(at(grid.HIGH) - 1.25) < 1e-9 and at(99) == 0


def test_keep_unlike_looks_back_over_kept(spark):
    df = spark.createDataFrame([([1, 9, 17, 25, 1],)], "v array<int>")
    fold = lambda n: df.select(grid.keep_unlike(F.col("v"), "array<int>", lambda k, x: k == x, n)).first()[0]
    assert fold(3) == [1, 9, 17, 25, 1] and fold(None) == [1, 9, 17, 25]


def test_tetrahedron_is_closed(spark):
    tris = spark.createDataFrame([(0, 0, "a", "b", "c"), (0, 1, "a", "c", "d"), (0, 2, "a", "d", "b"), (0, 3, "b", "d", "c")], "mesh_id long, tri long, ka string, kb string, kc string")
    assert mesh.non_manifold(tris).count() == 0 and mesh.flipped(tris).count() == 0
    turned = tris.where("tri < 3").unionByName(spark.createDataFrame([(0, 3, "b", "c", "d")], tris.schema))
    assert mesh.flipped(turned).count() == 3
    assert [r.idx for r in mesh.vertex_dictionary(tris).orderBy("idx").collect()] == [0, 1, 2, 3]
