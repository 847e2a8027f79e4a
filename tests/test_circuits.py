"""Routes, layouts and loops of a venue's ways on small venues."""

import random

import pyarrow as pa

from meridian.operators import circuit_loops, circuits, routes
from meridian.operators.routes import Way

A, B, C, D = (50.0, 5.0), (50.0, 5.02), (50.02, 5.02), (50.02, 5.0)
M, O = (50.01, 5.03), (50.01, 5.024)


def square(name="Main Circuit"):
    return [Way(1, [A, B], {"name": name}), Way(2, [B, M, C], {"name": name}), Way(4, [C, D], {"name": name}), Way(5, [D, A], {"name": name})]


def test_stitching_turns_ways_and_prefers_exact_ends():
    assert routes.stitch([[B, C], [B, A], [D, C]]) == [A, B, C, D]
    assert routes.stitch([[A, B], [(50.0, 5.0201), C], [B, D]]) == [A, B, D]
    assert routes.stitch([[A, B], [(50.0, 5.0201), C]]) == [A, B, C]
    assert routes.stitch([]) == [] and routes.stitch([[A, B], [C, D]]) == [A, B]


def test_cleanup_of_chains():
    back = [(50.0, 5.0), (50.0, 5.001), (50.0, 5.002), (50.0, 5.00102), (50.0, 5.003), (50.001, 5.003)]
    cleaned = routes.collapse_backtracks(back)
    assert (50.0, 5.002) not in cleaned and cleaned[0] == back[0] and cleaned[-1] == back[-1]
    for a, b, c in zip(cleaned, cleaned[1:], cleaned[2:]):
        assert not routes.is_backtrack(a, b, c)
    spike = [(0.0, 0.0), (0.0, 1.0), (0.0, 4.0), (0.0, 3.0), (0.0, 2.0), (0.0, 5.0), (0.0, 6.0)]
    turned = routes.turn_reversed_sections(spike)
    assert turned == [(0.0, float(x)) for x in range(5)][:2] + [(0.0, 4.0), (0.0, 2.0), (0.0, 3.0), (0.0, 5.0), (0.0, 6.0)]
    assert routes.turn_reversed_sections(spike[:5]) == spike[:5]
    ring = [A, B, C, D, (50.0001, 5.0)]
    assert routes.closed_if_near(ring)[-1] == A and routes.closed_if_near([A, B, C]) == [A, B, C]


def test_graph_walks():
    graph = routes.WayGraph([Way(0, [C, D]), Way(1, [B, C]), Way(2, [A, B]), Way(3, [D, A])])
    assert graph.ring([2, 1, 0, 3]).edges == [2, 1, 0, 3] and graph.ring([0, 1, 2]) is None
    star = routes.WayGraph([Way(0, [A, B]), Way(1, [A, C]), Way(2, [A, D])])
    assert star.backbone() is None
    fork = [*square(), Way(3, [B, O, C], {"name": "Club"}), Way(6, [A, (49.99, 4.99)])]
    graph = routes.WayGraph(fork)
    backbone = graph.backbone()
    assert sorted(backbone.edges) == [0, 1, 2, 3] and len(graph.cycles()) == 3
    (section,) = graph.sections(set(backbone.edges))
    assert [b.edges for b in section.branches] == [[1], [4]] and section.branches[0].on_backbone


def test_choice_of_a_component():
    loop = [Way(n, c) for n, c in enumerate(([(50.0, 6.0), (50.0, 6.02)], [(50.0, 6.02), (50.02, 6.02)], [(50.02, 6.02), (50.02, 6.0)], [(50.02, 6.0), (50.0, 6.0)]))]
    pit = [Way(9, [(51.0, 7.0), (51.004, 7.0)], {"name": "Monza"})]
    like = lambda name: circuits.like(name, "Monza")
    assert [w.id for w in routes.best_component(pit + loop, like)] == [0, 1, 2, 3]
    long = [Way(8, [(51.0, 7.0), (51.1, 7.0)], {"name": "Monza straight"})]
    assert [w.id for w in routes.best_component(loop + long, like)] == [8]
    assert routes.best_component(pit, like) == pit
    rng = random.Random(1)
    ways = [Way(n, [(rng.randint(0, 9) / 10, 0.0), (rng.randint(0, 9) / 10, 0.0)]) for n in range(8)]
    groups = routes.components(ways)
    assert sorted(x for g in groups for x in g) == list(range(8)) and [g[0] for g in groups] == sorted(g[0] for g in groups)


def elements(ways):
    return [{"type": "way", "id": w.id, "tags": w.tags, "geometry": [{"lat": a, "lon": b} for a, b in w.nodes]} for w in ways]


def test_layouts_of_forks(spark):
    ways = square("Circuit of X") + [Way(3, [B, O, C], {"name": "Moto"}), Way(6, [A, (49.99, 4.99)], {"name": "Service Spur"})]
    layouts, names = circuits.venue_layouts(elements(ways), "Circuit of X")
    assert [x.name for x in layouts] == ["Main", "Moto"] and names == ["Circuit of X", "Moto", "Service Spur"]
    assert all(x.nodes[0] == x.nodes[-1] for x in layouts) and O in layouts[1].nodes and M not in layouts[1].nodes
    assert circuits.venue_layouts([], "x") is None
    schema = "track long, name string, hints map<string,double>, elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,members:array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>>>"
    rows = [(1, "Circuit of X", None, [(e["type"], e["id"], e["tags"], [(p["lat"], p["lon"]) for p in e["geometry"]], None) for e in elements(ways)]), (2, None, None, None), (2, None, {}, [])]
    got = {(r.track, r.error): r for r in circuits.build_layouts(spark.createDataFrame(rows, schema)).collect()}
    assert [x.name for x in got[1, None].layouts] == ["Main", "Moto"] and got[2, "no ways"].layouts is None


def test_layouts_of_names():
    big = [Way(1, [A, B], {"name": "Grand Prix Circuit"}), Way(2, [B, M, C], {"name": "Grand Prix Circuit"}), Way(4, [C, D], {"name": "Grand Prix Circuit"}), Way(5, [D, A], {"name": "Grand Prix Circuit"})]
    variant = [Way(3, [B, O, C], {"name": "National Course"})]
    layouts, _ = circuits.venue_layouts(elements(big + variant), "X")
    assert [x.name for x in layouts] == ["Grand Prix Circuit", "National Course"]
    assert O in layouts[1].nodes and layouts[0].metres > layouts[1].metres


def relation(id, name, ways):
    return {"type": "relation", "id": id, "tags": {"type": "circuit", "name": name}, "members": [{"type": "way", "ref": w.id, "role": "", "geometry": [{"lat": a, "lon": b} for a, b in w.nodes]} for w in ways]}


def test_layouts_of_relations():
    plain = [Way(w.id, w.nodes) for w in square()]
    other = [Way(w.id + 20, [(a, b + 1) for a, b in w.nodes]) for w in square()]
    apart = elements(plain + other) + [relation(1, "North", plain), relation(2, "South", [Way(w.id, w.nodes) for w in other])]
    assert sorted(x.name for x in circuits.venue_layouts(apart, "X")[0]) == ["North", "South"]
    p, q = (50.017, 5.02), (50.0185, 5.0215)
    ring = [Way(1, [A, B]), Way(2, [B, p]), Way(3, [p, C]), Way(4, [C, D]), Way(5, [D, A])]
    shared = elements([*ring, Way(7, [p, q, C])]) + [relation(1, "Plain", ring), relation(2, "Chicane 2", [Way(7, [p, q, C]), *ring[:2], *ring[3:]])]
    layouts, _ = circuits.venue_layouts(shared, "X")
    assert sorted(x.name for x in layouts) == ["Chicane 2", "Plain"] and all(x.nodes[0] == x.nodes[-1] for x in layouts)
    assert q in next(x for x in layouts if x.name == "Chicane 2").nodes


def test_loops(spark):
    ways = [Way(1, [A, B, C, D], {"name": "Outer"}), Way(2, [D, A]), Way(3, [B, O, C], {"name": "Cut"}), Way(4, [A, (49.9, 4.9)])]
    got = circuit_loops.loops_of(ways)
    assert (got["junctions"], got["segments"], len(got["loops"])) == (5, 6, 3)
    assert [x["loop"] for x in got["loops"]] == [1, 2, 3] and got["unused"] == [{"way_id": 4, "name": ""}]
    small = got["loops"][0]
    assert small["names"] == ["Cut", "Outer"] and small["ways"][0]["from_node"] == {"lat": B[0], "lon": B[1]}
    node = lambda p: (p[0], p[1])
    rows = [(7, [(w.id, w.tags, [node(p) for p in w.nodes]) for w in ways]), (8, None)]
    found = {r.track: r for r in circuit_loops.find_loops(spark.createDataFrame(rows, "track long, ways array<struct<id:bigint,tags:map<string,string>,nodes:array<struct<lat:double,lon:double>>>>")).collect()}
    assert [x.metres for x in found[7].loops] == [x["metres"] for x in got["loops"]] and found[8].loops == []
    assert circuit_loops.sliced([A, B, C, D], B, D) == [B, C, D] and circuit_loops.sliced([A, B], None, None) == [A, B]
    try:
        circuit_loops.sliced([A, B, C], C, A)
        raise AssertionError
    except ValueError as error:
        assert "toNode" in str(error)


def test_equal_venues_are_laid_out_once(monkeypatch):
    made, real = [], circuits.venue_layouts
    monkeypatch.setattr(circuits, "venue_layouts", lambda *a: made.append(a) or real(*a))
    circuits._kept.clear(), circuits._places.clear()
    rows = [elements([*square(), Way(3, [B, O, C], {"name": "Moto"})]), [], elements([*square(), Way(3, [B, O, C], {"name": "Moto"})])]
    ask = lambda *d: circuits.layout_results(list(d), pa.array(["X"] * len(d)), pa.array([None] * len(d)), pa.array([rows["a-c".index(x[0])] for x in d])).to_pylist()
    one = ask("a", "-", "c", "a")
    assert len(made) == 3 and one[0] == one[2] == one[3] and one[1]["error"] == "no ways" and one[0]["layouts"]
    assert ask("c", "-") == [one[2], one[1]] and len(made) == 3
    monkeypatch.setattr(circuits, "KEPT_BYTES", 0)
    assert ask("a", "a") == [one[0]] * 2 and len(made) == 4
