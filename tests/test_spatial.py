"""Coverage of groups on small rows."""

import random

import pytest

from meridian.operators import spatial

POINTS = "id long, x double, y double, grp int"


def brute(rows, radius):
    groups = {g for *_, g in rows if g is not None}
    ids = {g: {} for g in groups}
    for k, x, y, g in rows:
        if g is not None and x is not None and y is not None:
            ids[g].setdefault(k, []).append((x, y))
    every = {g: [p for own in ids[g].values() for p in own] for g in groups}
    near = lambda p, g: any(abs(p[0] - x) + abs(p[1] - y) <= radius for x, y in every[g])
    full = {(a, b) for a in groups for b in groups if a != b and ids[a] and all(any(near(p, b) for p in own) for own in ids[a].values())}
    return sorted((a, b) for a, b in full if a < b and (b, a) in full)


def test_coverage_of_odd_points(spark):
    # A point without a place takes no part, an id of several points needs one of them, one that is not finite is near nothing.
    rows = [(1, 0.0, 0.0, 1), (2, None, 0.0, 1), (3, 0.1, 0.0, 2), (4, 0.2, 0.0, 2), (4, 9.0, 0.0, 2), (None, 0.0, 0.1, 2), (5, 0.0, 0.1, 3), (6, float("nan"), 0.0, 3), (7, 0.1, 0.1, None), (8, 1e300, 0.0, 4)]
    assert sorted(map(tuple, spatial.coverage(spark.createDataFrame(rows, POINTS), 0.3).collect())) == brute(rows, 0.3) == [(1, 2)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_coverage_is_that_of_all_pairs(spark, seed):
    r = random.Random(seed)
    # seed 0: on the lines of a grid, where distances are the radius but for rounding
    place = (lambda: round(r.uniform(-0.4, 0.4), 1)) if seed == 0 else lambda: r.gauss(0, 0.15)
    rows = [(i % 50 if seed == 2 else i, place(), place(), r.randrange(4)) for i in range(60)]
    assert sorted(map(tuple, spatial.coverage(spark.createDataFrame(rows, POINTS), 0.3).collect())) == brute(rows, 0.3)


def test_coverage_makes_no_pairs_of_copies(spark):
    # 40,000 points of each of two groups in one spot: pairs would be billions.
    df = spark.range(80_000).selectExpr("id", "id % 7 / 1000 as x", "0.0D as y", "cast(id % 2 as int) as grp")
    assert [tuple(x) for x in spatial.coverage(df, 0.3).collect()] == [(0, 1)]
