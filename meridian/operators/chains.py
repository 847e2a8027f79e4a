"""Operators on ordered chains of positions: rows (chain, idx, lat, lon) or one array a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

def in_order():
    """Window of a chain in order (made when called: it needs a session)."""
    return Window.partitionBy("chain").orderBy("idx")


def measures(points: DataFrame) -> DataFrame:
    """Points, length, gap between the ends, bounding area and mean position of each chain: one exchange."""
    step = geo.distance_m(F.lag("lat").over(in_order()), F.lag("lon").over(in_order()), F.col("lat"), F.col("lon"))
    at = F.struct("lat", "lon")
    g = points.withColumn("step", step).groupBy("chain").agg(
        F.count("*").alias("points"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length_m"), F.min_by(at, "idx").alias("a"), F.max_by(at, "idx").alias("b"),
        F.min("lat").alias("lat1"), F.max("lat").alias("lat2"), F.min("lon").alias("lon1"), F.max("lon").alias("lon2"), F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"),
    )
    area = (F.col("lat2") - F.col("lat1")) * geo.METRES * (F.col("lon2") - F.col("lon1")) * geo.METRES * F.cos(F.radians((F.col("lat1") + F.col("lat2")) / 2))
    return g.select("chain", "points", "length_m", geo.distance_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("gap_m"), area.alias("area_m2"), "mean_lat", "mean_lon")


def collect(points: DataFrame) -> DataFrame:
    """(chain, nodes): a chain's positions as one ordered array."""
    return points.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")))).alias("nodes"))


def samples(chains: DataFrame, k: int) -> DataFrame:
    """``k`` evenly spaced nodes (all, if fewer)."""
    n = F.size("nodes")
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("nodes", F.floor(i * n / k).cast("int")))
    return chains.withColumn("samples", F.when(n < k, F.col("nodes")).otherwise(picks))


def islands(points: DataFrame, inside: Column) -> DataFrame:
    """Maximal runs of neighbouring rows that are inside."""
    flagged = points.where(inside)
    gap = F.col("idx") - F.lag("idx").over(in_order())
    return flagged.withColumn("island", F.sum(F.when(gap == 1, 0).otherwise(1)).over(in_order()))


def backtracks(points: DataFrame, cosine: float = -0.9) -> DataFrame:
    """Marks nodes where a chain turns back on itself."""
    a, b, c, d = F.lag("lat").over(in_order()), F.lag("lon").over(in_order()), F.lead("lat").over(in_order()), F.lead("lon").over(in_order())
    u, v, x, y = F.col("lat") - a, F.col("lon") - b, c - F.col("lat"), d - F.col("lon")
    turn = u * x + v * y < F.lit(cosine) * F.sqrt(u * u + v * v) * F.sqrt(x * x + y * y)
    return points.withColumn("backtrack", F.coalesce(turn, F.lit(False)))


def drop_near_duplicates(chains: DataFrame, cell: float = 1e-5) -> DataFrame:
    """``kept``: nodes at least ``cell`` (sum of both degree differences) from the last one kept; a fold in order."""
    kind = chains.schema["nodes"].dataType.simpleString()

    def step(kept: Column, node: Column) -> Column:
        last = F.element_at(kept, -1)
        near = F.abs(last["lat"] - node["lat"]) + F.abs(last["lon"] - node["lon"]) < cell
        return F.when((F.size(kept) > 0) & near, kept).otherwise(F.array_append(kept, node))

    return chains.withColumn("kept", F.aggregate("nodes", F.array().cast(kind), step))


def close_if_near(chains: DataFrame, metres: float = 80.0) -> DataFrame:
    """The first node again at the end where the gap is at most ``metres``."""
    a, b = F.get("nodes", F.lit(0)), F.element_at("nodes", -1)
    near = (F.size("nodes") >= 2) & (geo.distance_m(a["lat"], a["lon"], b["lat"], b["lon"]) <= metres) & ((a["lat"] != b["lat"]) | (a["lon"] != b["lon"]))
    return chains.withColumn("nodes", F.when(near, F.array_append("nodes", a)).otherwise(F.col("nodes")))


def slice_closed(nodes: Column, start: Column, end: Column) -> Column:
    """Nodes from ``start`` to ``end`` of a closed chain without the node that closes it, over the seam where end lies before start."""
    ring = F.when(F.size(nodes) > 1, F.slice(nodes, F.lit(1), F.size(nodes) - 1)).otherwise(nodes)
    return F.when(start <= end, F.slice(ring, start + 1, end - start + 1)).otherwise(F.concat(F.slice(ring, start + 1, F.size(ring)), F.slice(ring, F.lit(1), end + 1)))
