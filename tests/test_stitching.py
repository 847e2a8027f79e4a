"""Declared ways joined into closed chains."""

from meridian.operators import stitching

KIND = "layout string, ways array<struct<id long, nodes array<struct<lat double, lon double>>>>"
A, B, C, D = (0.0, 0.0), (0.0, 0.01), (0.01, 0.01), (0.01, 0.0)


def stitched(spark, *ways):
    r = stitching.stitch(spark.createDataFrame([("x", list(ways))], KIND)).first()
    return (None if r.nodes is None else [tuple(p) for p in r.nodes]), r.error


def test_ways_turn_to_meet(spark):
    ring = [A, B, C, D, A]
    assert stitched(spark, (1, [A, B]), (2, [B, C]), (3, [C, D, A])) == (ring, None)
    assert stitched(spark, (1, [B, A]), (2, [C, B]), (3, [A, D, C])) == (ring, None)
    near = (0.00001, 0.0)
    assert stitched(spark, (1, [A, B, C]), (2, [C, D, near])) == (ring, None)
    assert stitched(spark, (1, [A, B])) == ([A, B], None)


def test_errors_are_said(spark):
    assert stitched(spark)[1] == 'Layout "x": no ways defined'
    assert stitched(spark, (1, [A, B]), (4, None))[1] == 'Layout "x": way 4 not found'
    assert stitched(spark, (1, [A]), (2, [A, B]))[1].endswith("way 1 has fewer than 2 nodes after slicing")
    assert "ways 1 and 2 do not share an endpoint (closest gap: 1113.2m)" in stitched(spark, (1, [A, B]), (2, [C, D]))[1]
    assert "way 3 does not connect to the previous way (gap: 1113.2m)" in stitched(spark, (1, [A, B]), (2, [B, C]), (3, [A, D]), (4, [D, A]))[1]
    nodes, error = stitched(spark, (1, [A, B]), (2, [B, C]))
    assert nodes is None and "chain does not form a closed loop (gap: 1574.3m" in error
