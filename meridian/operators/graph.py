"""Small-graph operators: degrees, components, bounded loop enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def degrees(edges: DataFrame) -> DataFrame:
    """(vid, degree) of (src, dst) edges; a self-loop counts twice."""
    ends = edges.select(F.col("src").alias("vid")).unionByName(edges.select(F.col("dst").alias("vid")))
    return ends.groupBy("vid").agg(F.count("*").alias("degree"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(vid, component): the smallest vertex reachable. Labels travel along edges and jump to their label's label.

    Each round is a partial aggregate and two equi-joins, and ends in a checkpoint; a hub's neighbours are never collected.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy(F.col("src").alias("vid")).agg(F.least("src", F.min("dst")).alias("label")))
    for _ in range(rounds):
        near = both.join(labels, both.dst == labels.vid).groupBy(F.col("src").alias("vid")).agg(F.min("label").alias("near"))
        step = labels.join(near, "vid").select("vid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("vid").alias("label"), F.col("label").alias("next"))
        after = cut(step.join(jump, "label", "left").select("vid", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = after.select("vid", "label")
        if after.where("label <> old").isEmpty():
            return labels.select("vid", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def loops(edges: DataFrame, most_edges: int, min_length: float = 0.0, max_length: float = float("inf")) -> DataFrame:
    """(loop_key, length, edges): simple loops of up to ``most_edges`` edges, each once, from its smallest vertex.

    Paths grow by one equi-join a round and are pruned by vertex order, length and depth before the next.
    """
    e = edges.where("src <> dst").select("eid", "src", "dst", F.col("length").cast("double").alias("length"))
    arcs = e.unionByName(e.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "length")).select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("eid").alias("by"), F.col("length").alias("add"))
    paths = arcs.where("to > at").select(F.col("at").alias("start"), F.col("to").alias("end"), F.array("at", "to").alias("seen"), F.array("by").alias("eids"), F.col("add").alias("length"))
    found = None
    for _ in range(most_edges - 1):
        grown = paths.join(arcs, F.col("end") == F.col("at")).where(~F.array_contains("eids", F.col("by")) & (F.col("to") >= F.col("start")))
        grown = grown.withColumn("total", F.col("length") + F.col("add")).where(F.col("total") <= max_length)
        closed = grown.where((F.col("to") == F.col("start")) & (F.col("total") >= min_length)).select(F.array_sort(F.array_append("eids", F.col("by"))).alias("eids"), F.col("total").alias("length"))
        found = closed if found is None else found.unionByName(closed)
        paths = grown.where((F.col("to") != F.col("start")) & ~F.array_contains("seen", F.col("to"))).select("start", F.col("to").alias("end"), F.array_append("seen", F.col("to")).alias("seen"), F.array_append("eids", F.col("by")).alias("eids"), F.col("total").alias("length"))
    return found.groupBy("eids").agg(F.round(F.min("length"), 6).alias("length")).select(F.array_join("eids", ",").alias("loop_key"), "length", F.size("eids").alias("edges"))
