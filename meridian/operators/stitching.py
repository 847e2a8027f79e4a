"""Layouts as declared lists of ways, joined end to end into a closed chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Degrees and metres within which ends meet, and the widest gap that is closed.
SAME, MEET_M, CLOSE_M = 1e-7, 2.0, 50.0


def _gap(p: Column, q: Column) -> Column:
    return geo.distance_m(p["lat"], p["lon"], q["lat"], q["lon"])


def _same(p: Column, q: Column) -> Column:
    return (F.abs(p["lat"] - q["lat"]) < SAME) & (F.abs(p["lon"] - q["lon"]) < SAME)


def _meet(p: Column, q: Column) -> Column:
    return _same(p, q) | (_gap(p, q) <= MEET_M)


def _tail(nodes: Column) -> Column:
    return F.element_at(nodes, -1)


def _head(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def _metres(gap: Column) -> Column:
    return F.format_string("%.1fm", gap)


def stitch(layouts: DataFrame) -> DataFrame:
    """(layout, ways array<struct<id, nodes array<struct<lat, lon>>>>) -> and ``nodes``, ``error``.

    The first way turns so that it meets the second; each next one so that it meets the chain's end. The chain's last
    node becomes its first where they are close. ``error`` says what does not fit and ``nodes`` is null then: no ways, a
    way that is null (not found) or has fewer than two nodes, ways that do not meet, a chain that stays open.
    A lone way is taken as it is. All is a fold over one row's array: no row is shuffled.
    """
    ways, name = F.col("ways"), F.concat(F.lit('Layout "'), F.coalesce(F.col("layout"), F.lit("")), F.lit('": '))
    short = F.filter(ways, lambda w: F.coalesce(F.size(w["nodes"]) < 2, F.lit(True)))
    bad = _head(short)
    said = F.when(F.coalesce(F.size(ways), F.lit(0)) <= 0, F.lit("no ways defined")).when(
        F.size(short) > 0, F.when(bad["nodes"].isNull(), F.concat(F.lit("way "), bad["id"].cast("string"), F.lit(" not found"))).otherwise(F.concat(F.lit("way "), bad["id"].cast("string"), F.lit(" has fewer than 2 nodes after slicing")))
    )
    rows = layouts.withColumn("__said", said)
    kind = layouts.schema["ways"].dataType.elementType["nodes"].dataType.simpleString()
    a, b = _head(ways)["nodes"], F.get(ways, F.lit(1))["nodes"]
    ahead, behind = _meet(_tail(a), _head(b)) | _meet(_tail(a), _tail(b)), _meet(_head(a), _head(b)) | _meet(_head(a), _tail(b))
    least = F.least(_gap(_tail(a), _head(b)), _gap(_tail(a), _tail(b)), _gap(_head(a), _head(b)), _gap(_head(a), _tail(b)))
    apart = F.concat(F.lit("ways "), _head(ways)["id"].cast("string"), F.lit(" and "), F.get(ways, F.lit(1))["id"].cast("string"), F.lit(" do not share an endpoint (closest gap: "), _metres(least), F.lit(")"))
    start = F.struct(F.when(ahead, a).when(behind, F.reverse(a)).otherwise(a).cast(kind).alias("nodes"), F.when(~ahead & ~behind, apart).cast("string").alias("error"))

    def step(acc: Column, way: Column) -> Column:
        end, nodes = _tail(acc["nodes"]), way["nodes"]
        forward, back = _meet(end, _head(nodes)), _meet(end, _tail(nodes))
        loose = F.concat(F.lit("way "), way["id"].cast("string"), F.lit(" does not connect to the previous way (gap: "), _metres(F.least(_gap(end, _head(nodes)), _gap(end, _tail(nodes)))), F.lit(")"))
        turned = F.when(forward, nodes).otherwise(F.reverse(nodes))
        chain = F.concat(acc["nodes"], F.slice(turned, F.lit(2), F.size(turned)))
        fits = acc["error"].isNull() & (forward | back)
        return F.struct(F.when(fits, chain).otherwise(acc["nodes"]).cast(kind).alias("nodes"), F.coalesce(acc["error"], F.when(~forward & ~back, loose)).cast("string").alias("error"))

    rest = F.slice(ways, F.lit(2), F.greatest(F.size(ways) - 1, F.lit(0)))
    rows = rows.withColumn("__chain", F.when(F.col("__said").isNull() & (F.size(ways) > 1), F.aggregate(rest, start, step)))
    chain = F.col("__chain.nodes")
    gap = _gap(_head(chain), _tail(chain))
    open_end = ~_same(_head(chain), _tail(chain)) & (gap > CLOSE_M)
    unclosed = F.concat(F.lit("chain does not form a closed loop (gap: "), _metres(gap), F.lit(" between first and last node)"))
    error = F.coalesce("__said", "__chain.error", F.when(open_end, unclosed))
    closed = F.concat(F.slice(chain, F.lit(1), F.greatest(F.size(chain) - 1, F.lit(0))), F.array(_head(chain)))
    rows = rows.withColumn("error", F.when(error.isNotNull(), F.concat(name, error)))
    nodes = F.when(F.col("error").isNull(), F.when(F.size(ways) == 1, a).otherwise(closed))
    return rows.withColumn("nodes", nodes).drop("__said", "__chain")
