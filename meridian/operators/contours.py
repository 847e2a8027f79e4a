"""Closed contours of a shape (glyph, contour, points array<struct<x, y>>): which lies in which, and the shapes they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes


def parents(rings: DataFrame) -> DataFrame:
    """(glyph, contour, parent): the smallest contour strictly about a contour's first point; null if none. Ties to the first.

    An equi-join on the glyph, whose contours are few.
    """
    inner = rings.select("glyph", "contour", F.get("points", F.lit(0)).alias("at"))
    area = F.abs(shapes.signed_area(F.col("points")))
    edge = lambda f, k: f(F.transform("points", lambda p: p[k]))
    outer = rings.select("glyph", F.col("contour").alias("parent"), "points", area.alias("area"), *[edge(f, k).alias(f"{n}{k}") for k in "xy" for n, f in (("low_", F.array_min), ("high_", F.array_max))])
    x, y = F.col("at.x"), F.col("at.y")
    boxed = (x > F.col("low_x")) & (x < F.col("high_x")) & (y > F.col("low_y")) & (y < F.col("high_y"))
    about = inner.join(outer, "glyph").where((F.col("contour") != F.col("parent")) & boxed & shapes.contains(F.col("points"), x, y))
    best = about.groupBy("glyph", "contour").agg(F.min_by("parent", F.struct("area", "parent")).alias("parent"))
    return rings.select("glyph", "contour").join(best, ["glyph", "contour"], "left")


def depths(links: DataFrame) -> DataFrame:
    """(glyph, contour, parent) -> and ``depth``: 0 for a root. Each glyph's links become one map, followed upwards."""
    book = links.where("parent is not null").groupBy("glyph").agg(F.map_from_entries(F.collect_list(F.struct("contour", "parent"))).alias("book"))
    start = F.struct(F.col("parent").alias("at"), F.lit(0).alias("depth"))

    def up(acc: Column, _: Column) -> Column:
        return F.struct(F.try_element_at("book", acc["at"]).alias("at"), F.when(acc["at"].isNull(), acc["depth"]).otherwise(acc["depth"] + 1).alias("depth"))

    walk = F.aggregate(F.map_keys("book"), start, up, lambda acc: acc["depth"])
    return links.join(book, "glyph", "left").select("glyph", "contour", "parent", F.coalesce(walk, F.lit(0)).alias("depth"))


def collect_shapes(rings: DataFrame) -> DataFrame:
    """(glyph, contour, outer, holes): contours of even depth run counter-clockwise, their children clockwise."""
    tree = depths(parents(rings)).join(rings.select("glyph", "contour", "points"), ["glyph", "contour"])
    left = shapes.counter_clockwise(F.col("points"))
    right = F.when(shapes.signed_area(F.col("points")) > 0, F.reverse("points")).otherwise(F.col("points"))
    outer = tree.where("depth % 2 = 0").select("glyph", "contour", left.alias("outer"))
    hole = F.struct("contour", right.alias("points"))
    holes = tree.where("depth % 2 = 1").groupBy("glyph", F.col("parent").alias("contour")).agg(F.transform(F.array_sort(F.collect_list(hole)), lambda h: h["points"]).alias("holes"))
    kind = holes.schema["holes"].dataType.simpleString()
    return outer.join(holes, ["glyph", "contour"], "left").withColumn("holes", F.coalesce("holes", F.array().cast(kind)))
