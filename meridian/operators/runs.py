"""Runs along closed chains, ways cut at junctions, and unique slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ring_runs(rows: DataFrame, value: str) -> DataFrame:
    """(chain, idx, value) -> (chain, run, value, size, start): runs of equal neighbours around a closed chain.

    The last run joins the first where their values agree; it then starts where the last one did. Nulls equal nulls.
    """
    w = Window.partitionBy("chain").orderBy("idx")
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag("idx").over(w).isNull()
    runs = rows.withColumn("run", F.sum(changed.cast("long")).over(w)).groupBy("chain", "run").agg(F.first(value).alias(value), F.count("*").alias("size"), F.min("idx").alias("start"))
    v = Window.partitionBy("chain").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(F.struct("run", value, "size", "start")).over(v)
    runs = runs.withColumn("last", last).withColumn("joins", (F.col("last.run") > 1) & F.first(value).over(v).eqNullSafe(F.col(f"last.{value}")))
    kept = runs.where(~F.col("joins") | (F.col("run") < F.col("last.run")))
    first = F.col("joins") & (F.col("run") == 1)
    return kept.select("chain", (F.col("run") - 1).alias("run"), value, F.when(first, F.col("size") + F.col("last.size")).otherwise(F.col("size")).alias("size"), F.when(first, F.col("last.start")).otherwise(F.col("start")).alias("start"))


def junctions(nodes: DataFrame) -> DataFrame:
    """(way, idx, key) -> keys that end a way or lie on two ways; ways of one node have no ends.

    Two partial aggregates; nothing of a key's rows is collected.
    """
    ends = nodes.groupBy("way").agg(F.count("*").alias("n"), F.min_by("key", "idx").alias("a"), F.max_by("key", "idx").alias("b")).where("n >= 2")
    tips = ends.select(F.explode(F.array("a", "b")).alias("key"))
    shared = nodes.groupBy("key").agg(F.min("way").alias("lo"), F.max("way").alias("hi")).where("lo <> hi").select("key")
    return tips.unionByName(shared).distinct()


def segments(nodes: DataFrame) -> DataFrame:
    """(way, idx, key) -> (way, segment, from_idx, to_idx, src, dst): ways cut at their junctions, in way order."""
    at = nodes.join(junctions(nodes), "key", "left_semi")
    w = Window.partitionBy("way").orderBy("idx")
    cut = at.select("way", F.col("idx").alias("from_idx"), F.lead("idx").over(w).alias("to_idx"), F.col("key").alias("src"), F.lead("key").over(w).alias("dst")).where("to_idx is not null")
    return cut.withColumn("segment", (F.row_number().over(Window.partitionBy("way").orderBy("from_idx")) - 1).cast("long"))


def unique_slugs(rows: DataFrame, group: str, slug: Column, *order: str) -> DataFrame:
    """``slug``: the same slug's second, third ... row of a group gets ``-2``, ``-3`` ... behind it."""
    rows = rows.withColumn("slug", slug)
    n = F.row_number().over(Window.partitionBy(group, "slug").orderBy(*order))
    return rows.withColumn("slug", F.when(n == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), n.cast("string"))))


def shared_members(rows: DataFrame) -> DataFrame:
    """(owner, group, member) -> (owner, everywhere, anywhere, ratio): members of all an owner's groups against of any."""
    rows = rows.select("owner", "group", "member").distinct()
    groups = rows.groupBy("owner").agg(F.countDistinct("group").alias("groups"))
    per = rows.groupBy("owner", "member").agg(F.count("*").alias("n")).join(groups, "owner")
    g = per.groupBy("owner").agg(F.count_if(F.col("n") == F.col("groups")).alias("everywhere"), F.count("*").alias("anywhere"))
    return g.withColumn("ratio", F.col("everywhere") / F.col("anywhere"))
