"""Boards, crossings, contours, layouts and reports on small rows."""

import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meridian.functions import text
from meridian.operators import contours, crossings, forks, layouts, plates
from meridian.sources import reports

LAYOUTS = "track int, track_name string, layouts array<struct<name: string, source_rank: int, metres: double, `group`: string, nodes: array<struct<lat: double, lon: double>>>>"


def loop(lat, lon=1.0):
    return [(lat, 0.0), (lat, lon), (lat, 0.0)]


def test_board_with_a_hole(spark):
    dims = plates.dimensions(spark.createDataFrame([(1, -20.0, -20.0, 40.0, 40.0)], "plate int, x0 double, y0 double, width double, height double"))
    square = lambda h: [(-h, -h), (h, -h), (h, h), (-h, h)]
    rings = spark.createDataFrame([(1, 0, 0, square(10.0)), (1, 0, 1, square(5.0)), (1, 1, 0, [(0.0, 0.0), (1.0, 1.0)])], "plate int, outline int, ring int, points array<struct<x: double, y: double>>")
    got = {(r.r, r.c): r for r in plates.text_mask(rings, rings.where("outline = 0 and ring = 0"), dims, F.lit(True)).collect()}
    assert len(got) == 400
    for (r, c), row in got.items():
        inside = 5 <= r <= 15 and 5 <= c <= 15
        bored = 8 <= r <= 11 and 8 <= c <= 11
        off = (2 * c - 19) ** 2 + (2 * r - 19) ** 2 > 400
        assert row.obstacle == (inside and not bored)
        assert row.blocked == (row.obstacle or off or r in (0, 19) or c in (0, 19))
        assert row.outside != (5 <= r <= 14 and 5 <= c <= 14)


def test_sloped_sides_touch_every_cell_they_pass(spark):
    dims = spark.createDataFrame([(1, 10, 10)], "plate int, rows long, cols long")
    side = (0.3, 0.2, 8.7, 6.1)
    got = {(r.r, r.c) for r in plates.touched(spark.createDataFrame([(1, *side), (1, 2.5, 12.0, 4.5, 12.0)], "plate int, x1 double, y1 double, x2 double, y2 double"), dims).collect()}
    t = np.linspace(0, 1, 100_001)
    want = {(int(y), int(x)) for x, y in zip(side[0] + t * (side[2] - side[0]), side[1] + t * (side[3] - side[1]))}
    assert got == want | {(9, 2), (9, 3), (9, 4)}


TRIS = [
    [0, 0, 0, 1, 0, 0, 0, 1, 0],
    [0.2, 0.2, -1, 0.2, 0.2, 1, 0.3, 0.9, 1],
    [0.1, 0.1, 0, 0.9, 0.1, 0, 0.1, 0.9, 0],
    [1, 0, 0, 1, 1, 0, 0, 1, 0],
    [5, 5, 5, 6, 5, 5, 5, 6, 5],
    [0, 0, 0, -1, 0, 0, 0, -1, 0],
]


def test_crossing_triangles(spark):
    rng = np.random.default_rng(3)
    rows = TRIS + (rng.random((40, 9)) * 2).round(3).tolist()
    df = spark.createDataFrame([(7, i, *map(float, t)) for i, t in enumerate(rows)], "mesh_id int, tri int, " + ", ".join(f"{c} double" for c in crossings.CORNERS))
    got = {(r.tri_a, r.tri_b): r.kind for r in crossings.crossings(df).collect()}
    t = np.array(rows, float).reshape(-1, 3, 3)
    want = {(a, b): k for a, b in itertools.combinations(range(len(t)), 2) if (k := crossings.kinds(t[a][None], t[b][None])[0]) and (a, b) != (0, 3)}
    assert got == want
    assert {p: k for p, k in got.items() if p[1] < len(TRIS)} == {(0, 1): "crossing", (0, 2): "coplanar", (1, 2): "crossing"}
    assert crossings.crossings(df.limit(0)).count() == 0


def test_weld_takes_the_first_vertex_in_reach(spark):
    at = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.009, 0.0, 0.0), (1, 2, 0.018, 0.0, 0.0), (1, 3, 1.0, 0.0, 0.0), (2, 0, 0.001, 0.0, 0.0)], "mesh_id int, v int, x double, y double, z double")
    assert {(r.mesh_id, r.v): r.rep for r in crossings.weld(at, 0.01).collect()} == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (1, 3): 3, (2, 0): 0}
    tris = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 1, 2, 3)], "mesh_id int, tri int, va int, vb int, vc int")
    assert [tuple(r) for r in crossings.weld_triangles(tris, at, 0.01).collect()] == [(1, 1, 0, 2, 3)]
    assert crossings.weld_triangles(tris, at, 0.0).count() == 2


def test_shapes_of_nested_contours(spark):
    rows = [("o", i, [(float(x), float(y)) for x, y in [(i, i), (10 - i, i), (10 - i, 10 - i), (i, 10 - i)]]) for i in range(4)] + [("i", 0, [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)])]
    df = spark.createDataFrame(rows, "glyph string, contour int, points array<struct<x: double, y: double>>")
    assert {(r.glyph, r.contour): (r.parent, r.depth) for r in contours.depths(contours.parents(df)).collect()} == {("o", 0): (None, 0), ("o", 1): (0, 1), ("o", 2): (1, 2), ("o", 3): (2, 3), ("i", 0): (None, 0)}
    made = {(r.glyph, r.contour): r for r in contours.collect_shapes(df).collect()}
    assert set(made) == {("o", 0), ("o", 2), ("i", 0)}
    assert [(p.x, p.y) for p in made["i", 0].outer] == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)] and made["i", 0].holes == []
    assert [(p.x, p.y) for p in made["o", 0].holes[0]] == [(1.0, 9.0), (9.0, 9.0), (9.0, 1.0), (1.0, 1.0)]


def test_layouts_rank_and_lose_their_copies(spark):
    rows = [("Junior", 0, 2400.0, None, loop(0.0)), ("Main", 0, 5800.0, None, loop(1.0)), ("main", 0, 5800.0, None, loop(1.0)), ("Monza", 1, 5700.0, None, loop(1.0, 1.0001)), ("flat oval layout", 0, 4000.0, "g", loop(3.0)), ("b", 0, 4000.5, "g", loop(3.0))]
    df = spark.createDataFrame([(1, "Monza", rows), (2, None, [])], LAYOUTS)
    names = lambda f: {r.track: [x.name for x in r.layouts] for r in f(df).collect()}
    assert names(layouts.rank) == {1: ["Monza", "Main", "main", "b", "Junior", "flat oval layout"], 2: []}
    assert names(layouts.one_of_each_name)[1] == ["Junior", "Main", "Monza", "flat oval layout", "b"]
    assert names(layouts.normalise) == {1: ["Monza", "b", "Junior", "Test Oval"], 2: []}


def test_branches(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    branch = lambda key, length, on: f"named_struct('key', '{key}', 'length', {length}D, 'on_backbone', {on})"
    label = lambda *b: {x.key: x.label for x in one(layouts.branch_labels(F.expr(f"array({', '.join(b)})")))}
    assert label(branch("a", 10, "false"), branch("b", 20, "false")) == {"b": "Main", "a": "Alternate"}
    assert label(branch("a", 19, "false"), branch("b", 20, "false")) == {"a": "Layout A", "b": "Layout B"}
    assert label(branch("a", 1, "true"), branch("b", 20, "false")) == {"a": "Main", "b": "Alternate"}
    picks = lambda e, n=8: one(layouts.branch_choices(F.expr(e), n))
    assert picks("array(array(1, 2), array(3, 4, 5))") == [list(p) for p in itertools.product((1, 2), (3, 4, 5))]
    assert picks("array(array(1, 2), array(3, 4, 5))", 4) == [[1, 3], [1, 4], [1, 5], [2, 3]]
    assert picks("array(array(1), cast(array() as array<int>))") == []


def test_modes_and_reports(spark):
    tracks = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "track string, layouts int")
    count = lambda v: {r.track: r["count"] for r in reports.sweep_plan(tracks, v).groupBy("track").count().collect()}
    assert [count(v) for v in ("sample", "all", "full")] == [{"b": 5, "c": 7}, {"b": 8, "c": 11}, {"b": 15, "c": 30}]
    row = ("Q1", "x" * 40, "flat/auto/single", "a very long part", 1, 2, 3, 4, 5, 6, None, None)
    fails = spark.createDataFrame([row], "track_id string, label string, mode string, part string, non_manifold int, degenerate int, t_junctions int, crossings int, flipped int, shells int, build_error string, first_edge string")
    lines = [r.line for r in reports.failure_report(fails, 1, 0, 1, "track_id").orderBy("part").collect()]
    assert lines[2] == "Q1".ljust(12) + "x" * 27 + "…" + "flat/auto/single".ljust(30) + "a very long part" + "       1      2      3      4     5       6  "
    assert lines[0].startswith("track id    label") and lines[1] == lines[3] == "-" * len(lines[0])
    assert lines[4] == "1 tracks built, 0 skipped (no geometry), 1 failures across 1 tracks (1 requested)"


def test_slug_and_waits(spark):
    rows = spark.createDataFrame([("Ñürburg & Ring!", "please wait 3 minutes"), (None, "Wait 2 HOURS"), ("-a-", "retry in 5 seconds"), ("", None)], "n string, b string")
    assert [tuple(r) for r in rows.select(text.slug(F.col("n")), text.retry_delay_seconds(F.col("b"))).collect()] == [("nurburg-ring", 180), ("", 7200), ("a", None), ("", None)]


def test_forks_and_rings(spark):
    ways = [(1, 0, 0, 1), (1, 1, 1, 2), (1, 2, 2, 0), (1, 3, 0, 3), (1, 4, 3, 2), (1, 5, 3, 4), (2, 0, 5, 6), (2, 1, 7, 6), (2, 2, 7, 5), (3, 0, 1, 2), (3, 1, 2, 1), (3, 2, 3, 4), (3, 3, 4, 3), (4, 0, 1, 2), (4, 1, 2, 1), (5, 0, 1, 2)]
    df = spark.createDataFrame([(*w, float(w[1] + 1)) for w in ways], "track int, eid int, a int, b int, length double")
    got = sorted((r.track, r.fork, r.merge, r.eids, r.length) for r in forks.branches(df).collect())
    assert got == [(1, 0, 2, [0, 1], 3.0), (1, 0, 2, [2], 3.0), (1, 0, 3, [3], 4.0), (1, 2, 0, [1, 0], 3.0), (1, 2, 0, [2], 3.0), (1, 2, 3, [4], 5.0), (1, 3, 0, [3], 4.0), (1, 3, 2, [4], 5.0), (1, 3, 4, [5], 6.0)]
    sections = [(r.fork, r.merge, [(b.on_backbone, b.eids) for b in r.branches], r.total) for r in forks.fork_sections(df, F.col("eid") == 2).collect()]
    assert sections == [(0, 2, [(True, [2]), (False, [0, 1])], 6.0)]
    assert forks.fork_sections(df, F.lit(False)).count() == 0
    assert {r.track: (r.eids, r.length) for r in forks.rings(df).collect()} == {2: ([0, 1, 2], 6.0), 4: ([0, 1], 3.0)}
    assert forks.branches(df.limit(0)).count() == forks.rings(df.limit(0)).count() == 0


def walks(rows):
    """Branches (track, fork, merge, eids, length, on_backbone, ends, near) by one walk each."""
    out = []
    for track in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == track]
        at = {}
        for _, eid, a, b, metres, main in own:
            for v, w in ((a, b), (b, a)):
                at.setdefault(v, []).append((eid, w, metres, main))
        near = {v for r in own if r[5] for v in r[2:4]}
        for fork in (v for v in at if v is not None and len(at[v]) >= 3):
            for eid, v, metres, main in at[fork]:
                eids, total, backbone = [eid], metres, main
                while v is not None and len(at[v]) == 2 and (more := [x for x in at[v] if x[0] != eids[-1]]):
                    eid, v, metres, main = more[0]
                    eids, total, backbone = [*eids, eid], None if None in (total, metres) else total + metres, backbone or main
                if v not in (None, fork) and len(at[v]) != 2:
                    out.append((track, fork, v, eids, total, backbone, len(at[v]), fork in near and v in near))
    return sorted(out, key=str)


def test_branches_are_those_of_walks(monkeypatch):
    # Tracks go over batches; some edges have no end, no length, the number of another, or both ends alike.
    monkeypatch.setattr(forks, "AT_ONCE", 20)
    for seed in range(20):
        r = random.Random(seed)
        rows = [(t, t * 100 + (r.randrange(9) if seed % 4 == 2 else i), r.randrange(n) if r.random() > 0.02 else None, r.randrange(n), None if r.random() < 0.03 else i + 0.1, r.random() < 0.4) for t in range(12) for n in [r.choice([5, 9, 14])] for i in range(r.choice([3, 9, 12, 45]))]
        t = pa.table(dict(zip(("track", "eid", "a", "b", "length", "main"), zip(*rows))), schema=pa.schema([("track", pa.int32()), ("eid", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("length", pa.float64()), ("main", pa.bool_())]))
        got = [tuple(x.values()) for b in forks._walk(iter(t.to_batches(max_chunksize=7))) for x in b.to_pylist()]
        assert sorted(got, key=str) == walks(rows)


def test_long_tracks_branch_alike(spark):
    r = random.Random(1)
    rows = [(t, t * 100 + i, r.randrange(9), r.randrange(9), i + 0.1, i % 2 == 0) for t in range(4) for i in range(8 + t)]
    df = spark.createDataFrame(rows, "track int, eid long, a long, b long, length double, main boolean").where("a <> b")
    want = walks([r for r in rows if r[2] != r[3]])
    for most in (0, 9, 99):
        found = forks._branches(df, most).select("track", "fork", "merge", "eids", "length", "on_backbone", "ends", "near").collect()
        assert sorted(map(tuple, found), key=str) == want


def test_sections_come_with_their_branches(spark):
    # The backbone and the ends come with each branch; tracks over ``most`` edges, by joins, have the same sections.
    ways = [(t, t * 10 + i, a, b, float(i + 1)) for t in (1, 2) for i, (a, b) in enumerate([(0, 1), (1, 2), (2, 0), (0, 3), (3, 2), (3, 4)][: 4 + t])]
    df = spark.createDataFrame(ways, "track int, eid long, a long, b long, length double")
    got = {most: sorted((r.track, r.fork, r.merge, [(b.on_backbone, b.eids) for b in r.branches], r.total) for r in forks.fork_sections(df, F.col("eid") % 10 == 2, most).collect()) for most in (5, 99)}
    assert got[5] == got[99] == [(1, 0, 2, [(True, [12]), (False, [13, 14]), (False, [10, 11])], 15.0), (2, 0, 2, [(True, [22]), (False, [20, 21])], 6.0)]


def test_masks_of_many_plates_are_those_of_joins(spark):
    # Sloped rings, two outlines, overlapping holes, margins, a plate without rings, two batches of plates.
    r = random.Random(3)
    dims = plates.dimensions(spark.createDataFrame([(k, -30.0, -20.0, w, h) for k, w, h in ((1, 60.0, 40.0), (2, 90.0, 84.0), (3, 17.0, 31.0), (4, 20.0, 20.0))], "plate int, x0 double, y0 double, width double, height double"))
    shape = lambda n: [(r.uniform(-40, 70), r.uniform(-30, 70)) for _ in range(n)]
    rows = [(k, o, i, shape(n)) for k in (1, 2, 3) for o, i, n in ((0, 0, 5), (0, 1, 4), (0, 2, 4), (1, 0, 3), (1, 1, 3), (1, 1, 4), (2, 0, 2))]
    rings = spark.createDataFrame(rows, "plate int, outline int, ring int, points array<struct<x: double, y: double>>")
    got = plates.text_mask(rings, rings.where("ring = 0 and outline < 2"), dims).collect()
    inside = plates.grid.fill_interior(plates.in_cells(plates.sides(rings.where("ring = 0 and outline < 2").select("plate", "points")), dims), dims.select("plate", "rows", "cols"), 1.0)
    drawn = {tuple(x) for x in plates.outline_cells(rings, dims).select("plate", "r", "c").distinct().collect()}
    inner, size = {tuple(x) for x in inside.select("plate", "r", "c").collect()}, {d.plate: d for d in dims.collect()}
    assert len(got) == sum(d.rows * d.cols for d in size.values()) and drawn and inner and size[2].margin == 1
    for x in got:
        d, m = size[x.plate], size[x.plate].margin
        near = any((x.plate, x.r + i, x.c + j) in drawn for i in range(-m, m + 1) for j in range(-m, m + 1))
        rim = x.r in (0, d.rows - 1) or x.c in (0, d.cols - 1)
        assert (x.obstacle, x.blocked, x.outside) == ((x.plate, x.r, x.c) in drawn, near or rim, (x.plate, x.r, x.c) not in inner)


def test_boards_of_one_number_are_drawn_apart(spark, tmp_path):
    from meridian.plans import boards

    spark.createDataFrame([(5, 1), (5, 30), (5, 30), (6, 2)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got = sorted(map(tuple, boards.board_outlines(spark, str(tmp_path)).collect()), key=str)
    # Number 5: 13 x 19 and twice 42 x 19 millimetres.
    assert got == sorted(db.sql(boards.ORACLES["board_outlines"]).fetchall(), key=str) and got[0][:2] == (5, 9 * 8 + 2 * 21 * 10)
