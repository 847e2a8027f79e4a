"""Paced and retried reading, and streams of requests."""

import json

import pytest
from pyspark.sql import functions as F

from meridian.sources import fetch
from meridian.streaming import chains, requests


def scripted(*answers):
    left, asked = list(answers), []

    def get(url):
        asked.append(url)
        return left.pop(0)

    return get, asked


def test_json_is_tried_again_with_doubled_delays():
    slept = []
    get, asked = scripted((500, {}, ""), (429, {}, ""), (200, {}, json.dumps({"a": 1})))
    assert fetch.read_json(get, "u", sleep=slept.append) == {"a": 1} and slept == [1.0, 2.0] and len(asked) == 3
    with pytest.raises(fetch.RequestFailed):
        fetch.read_json(scripted((404, {}, "no"))[0], "u", sleep=slept.append)
    with pytest.raises(fetch.RequestFailed):
        fetch.read_json(scripted(*[(503, {}, "")] * 5)[0], "u", sleep=slept.append)
    assert slept[2:] == [1.0, 2.0, 4.0, 8.0]


def test_pages_end_with_a_short_one():
    calls = []
    page = lambda at, n: calls.append(at) or list(range(at, min(at + n, 1000)))
    assert list(fetch.paged(page)) == list(range(1000)) and calls == [0, 500, 1000]


def test_pace_and_delays():
    clock, slept = [0.0], []
    pace = fetch.Pace(now=lambda: clock[0], sleep=lambda s: (slept.append(round(s, 6)), clock.__setitem__(0, clock[0] + s)))
    assert pace.wait() == 0 and round(pace.wait(), 6) == 1.2
    clock[0] += 5
    assert pace.wait() == 0
    assert fetch.delay_of({"Retry-After": "7"}, "wait 3 minutes", 0) == 7 and fetch.delay_of({}, "Please wait 3 minutes.", 0) == 180
    assert fetch.delay_of({"retry-after": "soon"}, "", 0) == 5 and fetch.delay_of({}, "", 9) == 15
    get, _ = scripted((429, {"retry-after": "2"}, ""), (200, {}, "xml"))
    assert fetch.read_map(get, "u", pace) == "xml" and 2.0 in slept
    with pytest.raises(fetch.TooManyNodes):
        fetch.read_map(scripted((400, {}, "You requested too many nodes"))[0], "u", pace)
    with pytest.raises(fetch.RequestFailed):
        fetch.read_map(scripted(*[(509, {}, "")] * 3)[0], "u", pace)
    assert fetch.read_or_none(scripted((410, {}, "gone"))[0], "u", pace) is None
    with pytest.raises(fetch.RequestFailed):
        fetch.read_or_none(scripted(*[(429, {}, "")] * 3)[0], "u", pace)


def test_boxes_split_and_margins_shrink():
    def read(box):
        if box[2] - box[0] > 0.3:
            raise fetch.TooManyNodes
        return f"{box[0]:.2f},{box[1]:.2f}"

    assert fetch.read_box(read, (0.0, 0.0, 0.5, 0.5)) == ["0.00,0.00", "0.00,0.25", "0.25,0.00", "0.25,0.25"]
    with pytest.raises(fetch.TooManyNodes):
        fetch.read_box(read, (0.0, 0.0, 0.5, 0.5), 0)

    def near(margin):
        if margin > 0.01:
            raise fetch.TooManyNodes
        return f"{margin:.4f}"

    assert fetch.read_around(near, 0.03) == "0.0075"
    with pytest.raises(fetch.TooManyNodes):
        fetch.read_around(lambda m: near(1.0), 0.03)
    with pytest.raises(ValueError):
        fetch.around(float("nan"), 0.0, 1.0)
    assert fetch.around(1.0, 2.0, 0.5) == (0.5, 1.5, 1.5, 2.5)


def test_addresses_are_read_by_partition(spark):
    def transport():
        return lambda url: (404, {}, "none") if url == "b" else (200, {}, url.upper())

    got = fetch.fetch_all(spark.createDataFrame([(1, "a"), (2, "b")], "key long, url string").coalesce(1), transport).collect()
    assert {(r.key, r.status, r.body) for r in got} == {(1, 200, "A"), (2, 404, None)}


def test_pixels(spark):
    rgba = bytearray(256 * 256 * 4)
    rgba[(3 * 256 + 2) * 4 : (3 * 256 + 2) * 4 + 4] = bytes((1, 255, 7, 9))
    tiles = spark.createDataFrame([(13, 5, 6, bytes(rgba))], "z int, tx long, ty long, rgba binary")
    at = spark.createDataFrame([(0, 13, 5, 6, 2, 3), (1, 13, 5, 7, 2, 3)], "i int, z int, tx long, ty long, px long, py long")
    got = {r.i: (r.r, r.g, r.b) for r in fetch.pixels_of(tiles, at).collect()}
    assert got == {0: (1, 255, 7), 1: (None, None, None)}


def test_latest_and_generations(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, None)], "k long, n long, v string")
    seen = []
    requests.latest_of_batch(lambda df, epoch: seen.extend((epoch, *r) for r in df.collect()), "k", "n")(rows, 3)
    assert sorted(seen) == [(3, 1, 7, "b"), (3, 2, 1, None)]
    tokens = spark.createDataFrame([(1, 1, None), (1, 2, "x"), (1, 3, "x"), (1, 4, None), (1, 5, "y")], "k long, n long, t string")
    assert [r.generation for r in requests.generations(tokens, "k", "n", "t").orderBy("n").collect()] == [0, 1, 1, 1, 2]
    starts = spark.createDataFrame([([0.0, 0.5, 5.0],), ([],)], "t array<double>").select(requests.paced(F.col("t"))).collect()
    assert [[round(x, 6) for x in r[0]] for r in starts] == [[0.0, 1.2, 5.0], []]


def test_settled_queries(spark):
    rows = [("u", "2024-01-01 00:00:00.000", "mo"), ("u", "2024-01-01 00:00:00.500", "mon"), ("u", "2024-01-01 00:00:01.200", "monza "), ("u", "2024-01-01 00:00:05.000", "x"), ("v", "2024-01-01 00:00:00.100", "spa")]
    df = spark.createDataFrame(rows, "user string, at string, q string").withColumn("at", F.to_timestamp("at"))
    got = requests.settled_queries(df, "user", "at", "q", "10 seconds").collect()
    assert sorted((r.user, r.q) for r in got) == [("u", "monza"), ("v", "spa")]


def test_stale_answers_go(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, 5, "new"), (2, 1, "b")], "k long, n long, v string").coalesce(1).write.parquet(folder)
    stream = chains.read_events(spark, folder, "k long, n long, v string", 1)
    query = requests.current_answers(stream, "k", "n").writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    spark.createDataFrame([(1, 4, "stale"), (1, 6, "newer"), (2, 1, "again")], "k long, n long, v string").coalesce(1).write.mode("append").parquet(folder)
    query.processAllAvailable()
    query.stop()
    assert sorted(r.v for r in spark.table("answers").collect()) == ["again", "b", "new", "newer"]


def test_first_of_keys(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.sql("select 1L as k, timestamp'2024-01-01' as at union all select 1L, timestamp'2024-01-01' union all select 2L, timestamp'2024-01-01'").coalesce(1).write.parquet(folder)
    stream = chains.first_of_keys(chains.read_events(spark, folder, "k long, at timestamp"), "k", "at", "1 hour")
    query = stream.writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.k for r in spark.table("firsts").collect()) == [1, 2]
