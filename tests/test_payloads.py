"""Payloads of services, their addresses, and folders of JSON files."""

import json

import pytest
from pyspark.sql import functions as F

from meridian.operators import chains
from meridian.sources import payloads, sinks, ways


def test_entity_details(spark, tmp_path):
    claim = lambda v: {"mainsnak": {"datavalue": {"value": v}}}
    full = {
        "labels": {"en": {"value": "Monza"}, "it": {"value": "x"}},
        "aliases": {"en": [{"value": "Autodromo"}, {"value": ""}, {"value": "AM"}]},
        "descriptions": {"en": {"value": "circuit"}},
        "claims": {"P1813": [{"mainsnak": {}}, claim({"text": "MZ", "language": "en"})], "P17": [claim({"id": "Q38"}), claim({"id": "Q1"})], "P131": [claim({"id": "Q5"})], "P740": [claim({"id": "Q6"})], "P276": [claim({"id": "Q7"}), {"mainsnak": {}}]},
    }
    (tmp_path / "a.json").write_text(json.dumps({"entities": {"Q1": full, "Q2": {}}}))
    df = spark.read.schema(payloads.ENTITIES).json(str(tmp_path))
    got = {r.id: tuple(r)[1:] for r in payloads.entity_details(df, spark.createDataFrame([("Q1",), ("Q2",), ("Q3",)], "id string")).collect()}
    assert got["Q1"] == ("Monza", ["Autodromo", "AM"], "circuit", "MZ", "Q38", ["Q6", "Q7", "Q5"])
    assert got["Q2"] == got["Q3"] == (None, [], None, None, None, [])


def test_payload_ways(spark):
    at = lambda *v: [(float(x), 0.0) for x in v]
    way = lambda i, tags, g: ("way", i, tags, g, None)
    rel = lambda tags, *m: ("relation", 99, tags, None, list(m))
    elements = [
        rel({"name": " Full ", "sport": "motor", "lit": "no"}, ("way", 1, "", at(7, 8)), ("way", 3, None, at(3, 4)), ("node", 1, "", at(1, 2)), ("way", 2, "pit_lane", at(9, 9))),
        way(1, {"name": "Kurve", "surface": "asphalt"}, at(1, 2)),
        way(1, {"name": "later"}, at(5, 6)),
        way(2, None, at(1, 2, 3)),
        way(4, {}, at(1)),
        rel({"name": "Short", "lit": "yes"}, ("way", 1, "", at(8, 9)), ("way", 1, "", at(1))),
        rel({"name": "Full"}, ("way", 1, "", at(2, 1))),
    ]
    df = spark.createDataFrame([(1, elements), (2, [way(1, {"x": "y"}, at(4, 4))]), (3, None)], f"payload int, {payloads.ELEMENTS}")
    ways = payloads.payload_ways(df)
    got = {(r.payload, r.id): (r.tags, r.relation_names, [p.lat for p in r.nodes]) for r in ways.collect()}
    assert got == {
        (1, 1): ({"name": "Kurve", "surface": "asphalt", "sport": "motor", "lit": "no"}, ["Full", "Short"], [2.0, 1.0]),
        (1, 2): ({}, [], [1.0, 2.0, 3.0]),
        (1, 3): ({"name": " Full ", "sport": "motor", "lit": "no"}, ["Full"], [3.0, 4.0]),
        (2, 1): ({"x": "y"}, [], [4.0, 4.0]),
    }
    assert {(r.payload, r.id) for r in payloads.first_of_ways(ways).collect()} == {(1, 1), (1, 2), (1, 3)}


def test_addresses(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda *v: [F.lit(x) for x in v]
    assert one(payloads.box_url("u", *lit(1.0, 2.0, 3.5, 4.25))) == "u?bbox=2.0,1.0,4.25,3.5"
    assert one(payloads.around_url("u", *lit(1.0, 2.0, 0.5))) == "u?bbox=1.5,0.5,2.5,1.5"
    assert one(payloads.way_url("u", F.lit(17))) == "u/17/full"
    for bad in (payloads.box_url("u", *lit(3.0, 2.0, 3.0, 4.0)), payloads.box_url("u", *lit(float("nan"), 2.0, 3.0, 4.0)), payloads.around_url("u", *lit(1.0, 2.0, 0.0)), payloads.way_url("u", F.lit(0))):
        with pytest.raises(Exception, match="must"):
            one(bad)


def test_folder_scan(spark, tmp_path):
    for name, body in (("Q1.json", '{\n "name": "a"}'), ("Q2.json", '{"name": "b"}'), ("readme.txt", "x")):
        (tmp_path / name).write_text(body)
    rows, missing = payloads.folder_scan(spark, str(tmp_path), "name string", ["Q2", "Q9"])
    assert [tuple(r) for r in rows.collect()] == [("Q2", "b")] and [r.id for r in missing.collect()] == ["Q9"]
    assert payloads.folder_scan(spark, str(tmp_path), "name string")[0].count() == 2


def test_index_of_documents(spark, tmp_path):
    for i, n in (("Q1", 3), ("Q2", 2), ("Q3", 0)):
        nodes = [{"lat": float(k), "lon": 0.0} for k in range(n)]
        (tmp_path / f"{i}.json").write_text(json.dumps({"trackId": i, "name": i.lower(), "layouts": [{"name": "Main", "nodes": nodes}] if n else []}, indent=1))
    docs = ways.documents(spark, str(tmp_path))
    assert docs.count() == 3
    assert [r[0] for r in ways.buildable(docs).select("name").collect()] == ["q1"]
    lines = [json.loads(r.json)["name"] for r in sinks.sorted_array(docs.select("name"), "name").collect()]
    assert lines == ["q1", "q2", "q3"]


def test_closing_and_slicing_chains(spark):
    near, far = 80 / 111_320 * 0.99, 80 / 111_320 * 1.01
    rows = [(1, [(0.0, 0.0), (1.0, 0.0), (near, 0.0)]), (2, [(0.0, 0.0), (1.0, 0.0), (far, 0.0)]), (3, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]), (4, [(0.0, 0.0), (near, 0.0)])]
    df = spark.createDataFrame(rows, "chain int, nodes array<struct<lat: double, lon: double>>")
    closed = {r.chain: [p.lat for p in r.nodes] for r in chains.close_if_near(df).collect()}
    assert closed == {1: [0.0, 1.0, near, 0.0], 2: [0.0, 1.0, far], 3: [0.0, 1.0, 0.0], 4: [0.0, near, 0.0]}
    cut = lambda a, b: spark.range(1).select(chains.slice_closed(F.expr("array(0, 1, 2, 3, 4)"), F.lit(a), F.lit(b)).alias("x")).first().x
    assert cut(1, 3) == [1, 2, 3] and cut(2, 2) == [2]
    assert cut(3, 1) == [3, 0, 1] and cut(2, 9) == [2, 3]
