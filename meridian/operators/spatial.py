"""Radius, nearest-k and coverage joins by grid cells: an equi-join on cells, then the exact test. No nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

#: Numbers of cells up to which rounding is far less than the room left for it.
CELLS_EXACT = 10**12


def _cell(x: str, y: str, size: float) -> tuple[Column, Column]:
    return F.floor(F.col(x) / size).cast("long"), F.floor(F.col(y) / size).cast("long")


def radius_pairs(a: DataFrame, b: DataFrame, radius: float, metric: str = "manhattan") -> DataFrame:
    """(a_id, b_id, dist) of points (id, x, y) of both sides at most ``radius`` apart."""
    cx, cy = _cell("x", "y", radius)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), cx.alias("cx"), cy.alias("cy"))
    right = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), cx.alias("ox"), cy.alias("oy"), F.explode(near).alias("d"))
    right = right.select("b_id", "bx", "by", (F.col("ox") + F.col("d.i")).alias("cx"), (F.col("oy") + F.col("d.j")).alias("cy"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    dist = F.abs(dx) + F.abs(dy) if metric == "manhattan" else F.sqrt(dx * dx + dy * dy)
    return left.join(right, ["cx", "cy"]).select("a_id", "b_id", dist.alias("dist")).where(F.col("dist") <= radius)


def nearest_within(a: DataFrame, b: DataFrame, radius: float, k: int) -> DataFrame:
    """The ``k`` nearest of ``b`` within ``radius`` of each ``a``, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy("dist", "b_id"))
    return radius_pairs(a, b, radius).where("a_id <> b_id").withColumn("rank", rank).where(F.col("rank") <= k)


def _near_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of cells ``a`` (fx, fy, ..) and ``b`` (bx, by, ..) that may hold points within a radius, ``sure`` where all of theirs are.

    Equi-join on coarse cells of 5, of which a radius spans no more than two.
    """
    coarse = lambda c: F.floor(F.col(c) / 5).cast("long")
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.withColumn("d", F.explode(near)).withColumn("cx", coarse("bx") + F.col("d.i")).withColumn("cy", coarse("by") + F.col("d.j")).drop("d")
    i, j = F.abs(F.col("fx") - F.col("bx")), F.abs(F.col("fy") - F.col("by"))
    exact = F.greatest(*[F.abs(F.col(c)) for c in ("fx", "fy", "bx", "by")]) < CELLS_EXACT
    pairs = a.withColumn("cx", coarse("fx")).withColumn("cy", coarse("fy")).join(right, ["cx", "cy"]).drop("cx", "cy")
    return pairs.where(F.greatest(i - 1, F.lit(0)) + F.greatest(j - 1, F.lit(0)) <= 4).withColumn("sure", (i + j <= 2) & exact)


def coverage(points: DataFrame, radius: float) -> DataFrame:
    """(a_group, b_group): every id of each group has a point within ``radius`` of some point of the other.

    No pairs of points are made where cells tell: cells of about a quarter of the radius are paired, once each and by
    group. Points no more than two cells apart are near, so only points of cells that have a group's points in reach, but
    none so close, are compared, each place once, and only for pairs of groups of which no point is out of reach. Points
    without a place (null) take no part; those that are not finite are near nothing.
    """
    side = radius * 0.999 / 4
    at = lambda c: F.floor(F.least(F.greatest(F.col(c) / side, F.lit(-1e15)), F.lit(1e15))).cast("long")
    finite = lambda c: F.abs(F.col(c)) < F.lit(float("inf"))
    p = points.where("grp is not null and x is not null and y is not null").select(F.struct("id").alias("id"), "grp", "x", "y", (finite("x") & finite("y")).alias("there"))
    p = p.withColumn("fx", F.when(F.col("there"), at("x"))).withColumn("fy", F.when(F.col("there"), at("y")))
    ids = p.groupBy("grp", "id").agg(F.count("*").alias("rows"), F.max("there").alias("there"), F.min("fx").alias("fx"), F.min("fy").alias("fy"))
    # An id of one row is hit where its cell is; ids of several are looked at one by one below.
    single = cut(ids.where("rows = 1").groupBy("grp", "there", "fx", "fy").agg(F.count("*").alias("n")))
    cells = cut(p.where("there").select("grp", "fx", "fy").distinct())
    places = p.where("there").select(F.col("fx").alias("bx"), F.col("fy").alias("by"), F.col("grp").alias("gb"), F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    own = cells.select(F.col("fx").alias("bx"), F.col("fy").alias("by"), F.col("grp").alias("gb"))
    reach = cut(_near_cells(cells.select("fx", "fy").distinct(), own).groupBy("fx", "fy", "gb").agg(F.max("sure").alias("sure")))
    # Pairs of groups that no single id rules out: of all their cells none is out of reach.
    seen = single.join(reach, ["fx", "fy"]).where("grp <> gb").groupBy("grp", "gb").agg(F.count("*").alias("seen"))
    of_all = single.groupBy("grp").agg(F.count("*").alias("of_all"))
    several = ids.where("rows > 1").select("grp", "id")
    met = seen.join(of_all, "grp").where("seen = of_all").select("grp", "gb")
    lone = cells.join(single.select("grp").distinct(), "grp", "left_anti").join(reach, ["fx", "fy"]).where("grp <> gb").select("grp", "gb").distinct()
    one_way = met.unionByName(lone)
    left = cut(one_way.intersect(one_way.select(F.col("gb").alias("grp"), F.col("grp").alias("gb"))))
    # What is not settled: single ids of cells that are not sure, and all rows of ids of several rows.
    doubtful = single.where("there").select("grp", "fx", "fy").join(reach.where("not sure"), ["fx", "fy"]).join(left, ["grp", "gb"], "left_semi").select("grp", "gb", "fx", "fy")
    open_single = p.where("there").join(ids.where("rows = 1").select("grp", "id"), ["grp", "id"], "left_semi").join(doubtful, ["grp", "fx", "fy"]).select("grp", "gb", "id", "x", "y", "fx", "fy", F.lit(False).alias("hit"))
    rows = p.join(several, ["grp", "id"], "left_semi").join(left, "grp").join(reach, ["fx", "fy", "gb"], "left")
    rows = cut(open_single.unionByName(rows.select("grp", "gb", "id", "x", "y", "fx", "fy", F.coalesce("sure", F.lit(False)).alias("hit"))))
    asked = rows.where("not hit and fx is not null").select("gb", "x", "y", "fx", "fy").distinct()
    close = _near_cells(asked.select("fx", "fy", F.col("gb").alias("want")).distinct(), own).where("gb = want").select("fx", "fy", "gb", "bx", "by")
    d = F.abs(F.col("x") - F.col("px")) + F.abs(F.col("y") - F.col("py"))
    found = close.join(places, ["bx", "by", "gb"]).join(asked, ["fx", "fy", "gb"]).where(d <= radius).select("gb", "x", "y").distinct().withColumn("found", F.lit(True))
    told = rows.join(found, ["gb", "x", "y"], "left").groupBy("grp", "gb", "id").agg(F.max(F.col("hit") | F.coalesce("found", F.lit(False))).alias("hit"))
    full = cut(left.join(told.where("not hit"), ["grp", "gb"], "left_anti"))
    back = full.select(F.col("gb").alias("grp"), F.col("grp").alias("gb"))
    return full.join(back, ["grp", "gb"]).where("grp < gb").select(F.col("grp").alias("a_group"), F.col("gb").alias("b_group"))
