"""Names, lines, shells, map files, sinks and streams on small rows."""

import itertools
import struct

import pytest
from pyspark.sql import functions as F

from meridian.functions import lines
from meridian.operators import graph, grid, mesh, names, runs
from meridian.sources import sinks, ways
from meridian.streaming import chains as live

NAMES = "label string, aliases array<string>, short_name string, description string, seen_names array<string>, layout string"


@pytest.mark.parametrize(
    "row, want",
    [
        (("Silverstone Circuit", [], "Silverstone", "circuit", [], "National Circuit"), ("Silverstone Circuit", "National Circuit", "Silverstone National Circuit")),
        (("Monza", ["Autodromo Nazionale Monza"], None, None, None, "Main"), ("Autodromo Nazionale Monza", None, "Autodromo Nazionale Monza")),
        (("Belgian Grand Prix", ["Circuit de Spa-Francorchamps"], None, None, [], "Moto Circuit"), ("Circuit de Spa-Francorchamps", "Moto Circuit", "Spa-Francorchamps Moto Circuit")),
        ((None, None, None, None, None, None), ("Unknown", None, "Unknown")),
        (("Track near Rome, Italy", [], "Vallelunga", "x", [], "Vallelunga"), ("Vallelunga", None, "Vallelunga")),
    ],
)
def test_printed_names(spark, row, want):
    r = names.printed_names(spark.createDataFrame([row], NAMES)).first()
    assert (r.base_name, r.suffix, r.printed_name) == want


def test_label_of_layout(spark):
    rows = spark.createDataFrame([("Main", 5891.0, 0), (" ", None, 1), (None, 1000.0, 2)], "n string, m double, i int")
    got = [r[0] for r in rows.select(names.layout_label(F.col("n"), F.col("m"), F.col("i"))).collect()]
    assert got == ["Main - 5.9 km", "Layout 2", "Layout 3 - 1.0 km"]


def test_lines_are_the_cheapest_split():
    words = "a international of circuit the great north bb".split()
    widths = [float(len(w)) for w in words]
    for k in (2, 3, 4):
        target = (sum(widths) + len(words) - 1) / k

        def cost(parts):
            last = parts[-1]
            return sum((target - len(" ".join(p))) ** 2 for p in parts) + (10 * target**2 if len(last) == 1 and len(last[0]) / target < 0.65 else 0)

        every = [[words[a:b] for a, b in itertools.pairwise((0, *c, len(words)))] for c in itertools.combinations(range(1, len(words)), k - 1)]
        got = [x.split() for x in lines.break_lines(words, k, widths, 1.0)]
        assert sum(got, []) == words and cost(got) == pytest.approx(min(map(cost, every)))
    assert lines.break_lines([], 2, [], 1.0) == [""] and lines.break_lines(["a", "b"], 3, [1, 1], 1.0) == ["a", "b"]


def test_shells(spark):
    faces = ["abc", "acd", "adb", "bdc"]
    rows = [(0, i, *f) for i, f in enumerate(faces)] + [(0, 10 + i, *f.upper()) for i, f in enumerate(faces[:3])] + [(1, i, *f) for i, f in enumerate(faces)]
    tris = spark.createDataFrame(rows, "mesh_id long, tri long, ka string, kb string, kc string")
    assert {tuple(r) for r in mesh.shell_counts(tris).collect()} == {(0, 2, 1), (1, 1, 0)}


def test_components_match_union_find(spark):
    import random

    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.vid: r.component for r in graph.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p}


def test_empty_rectangles(spark):
    blocked = {(1, 1)}
    cells = spark.createDataFrame([(0, r, c, (r, c) in blocked) for r in range(3) for c in range(3)], "plate long, r long, c long, blocked boolean")
    got = {tuple(r)[1:] for r in grid.empty_rectangles(cells).collect()}
    assert got == {(0, 0, 0, 2), (2, 0, 2, 2), (0, 0, 2, 0), (0, 2, 2, 2)}


def test_ring_runs_join_over_the_seam(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate("aabba")] + [(1, 0, "x")], "chain long, idx long, way string")
    assert {tuple(r) for r in runs.ring_runs(df, "way").collect()} == {(0, 0, "a", 3, 4), (0, 1, "b", 2, 2), (1, 0, "x", 1, 0)}


XML = """<osm><node id="1" lat="1.5" lon="2"/><node id="2" lat="3" lon="4"><tag k="a" v="b"/></node>
<way id="7"><nd ref="1"/><nd ref="9"/><nd ref="2"/><tag k="name" v="A &amp;amp; &quot;B&quot;"/></way><way id="8"><nd ref="1"/></way>
<relation id="5"><member type="way" ref="7" role="x"/><member type="way" ref="99"/><tag k="type" v="circuit"/></relation><relation id="6"/></osm>"""


def test_map_xml(spark):
    xml = spark.createDataFrame([("f", XML), ("g", None), ("h", "")], "file string, text string")
    w = ways.ways(xml).collect()
    assert [(r.id, r.tags, [tuple(p) for p in r.geometry]) for r in w] == [(7, {"name": 'A &amp; "B"'}, [(1.5, 2.0), (3.0, 4.0)])]
    r = {x.id: x for x in ways.relations(xml).collect()}
    assert [(m.ref, m.role, m.geometry is None) for m in r[5].members] == [(7, "x", False), (99, "", True)]
    assert r[5].tags == {"type": "circuit"} and r[6].members == []


def test_documents_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "track_id string, n long")
    at = f"file://{tmp_path}/out"
    assert tuple(sinks.write_documents(df.where("n = 1"), at, "track_id", dry_run=True).first()) == (1, 0)
    assert tuple(sinks.write_documents(df.where("n = 1"), at, "track_id").first()) == (1, 0)
    assert tuple(sinks.write_documents(df, at, "track_id").first()) == (1, 1)
    assert sorted((r.track_id, r.n) for r in spark.read.json(at).collect()) == [("a", 1), ("b", 2)]
    assert tuple(sinks.write_documents(df.withColumn("n", F.col("n") + 5), at, "track_id", force=True).first()) == (2, 0)
    assert sorted(r.n for r in spark.read.json(at).collect()) == [6, 7]


def test_triangle_records(spark):
    corners = ["ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"]
    df = spark.createDataFrame([(1, *map(float, (0, 0, 0, 1, 0, 0, 0, 1, 0))), (2, *map(float, (0, 0, 0, 0, 0, 0, 0, 1, 0)))], ["tri", *corners])
    (r,) = sinks.triangle_records(df, corners, ["tri"]).collect()
    assert len(r.record) == 50 and struct.unpack("<12fH", r.record) == (0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0)
    head = sinks.triangle_header("xéy", 1)
    assert len(head) == 84 and head[:3] == b"x y" and head[80:] == b"\x01\0\0\0"


def test_file_names(spark):
    df = spark.createDataFrame([("My  Track!.3mf",), ("???",), ("--A__b",)], "n string")
    assert [r[0] for r in df.select(sinks.file_name(F.col("n"))).collect()] == ["my-track-.3mf", "model.3mf", "a__b.3mf"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select id % 3 as chain, timestamp_seconds(id * 20) as ts, cast(id as double) as lat, cast(-id as double) as lon from range(50)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = live.read_events(spark, f"{tmp_path}/in", "chain long, ts timestamp, lat double, lon double")
    q = live.window_measures(stream, "ts", "5 minutes", "1 hour").writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = live.window_measures(rows, "ts", "5 minutes", "1 hour")
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, want.collect()))
