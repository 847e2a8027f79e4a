"""Column functions on arrays of points (x, y), rings and triangles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """Quarter turns clockwise; other angles count as none."""
    turn = F.pmod(degrees, F.lit(360))
    return F.when(turn == 90, y).when(turn == 180, -x).when(turn == 270, -y).otherwise(x), F.when(turn == 90, -x).when(turn == 180, -y).when(turn == 270, x).otherwise(y)


def fit_scale(width: Column, depth: Column, size: float = 200.0) -> Column:
    longest = F.greatest(width, depth)
    return F.when(longest > 0, size / longest).otherwise(1.0)


def ribbon_width(printed: Column, longest: Column, margin: Column, size: float = 200.0, fallback: float = 12.0) -> Column:
    """Metres of a ribbon that is ``printed`` mm wide once the plate is scaled to ``size`` mm."""
    return F.when((printed > 0) & (printed < size), printed * (longest + margin) / (size - printed)).otherwise(fallback)


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, F.pmod(i + 1, F.size(ring)).cast("int"))


def signed_area(ring: Column) -> Column:
    """Positive where the ring runs counter-clockwise."""
    terms = F.transform(ring, lambda p, i: p["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a ring."""

    def crossed(p: Column, i: Column) -> Column:
        q = _next(ring, i)
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])

    hits = F.transform(ring, lambda p, i: F.when(crossed(p, i), 1).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda a, b: a + b) % 2 == 1


def circle(cx: Column, cy: Column, radius: Column, corners: int) -> Column:
    angle = lambda i: i * (2 * math.pi / corners)
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda i: F.struct((cx + radius * F.cos(angle(i))).alias("x"), (cy + radius * F.sin(angle(i))).alias("y")))


def triangle_area(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Half the length of the cross product of two sides."""
    u, v = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
    n = [u[i] * v[j] - u[j] * v[i] for i, j in ((1, 2), (2, 0), (0, 1))]
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2


def grid_key(value: Column, step: float) -> Column:
    """Number of the grid line nearest to a value, halves upwards."""
    return F.floor(value / step + 0.5).cast("long")
