"""Triangle-mesh checks on rows (mesh_id, tri, ka, kb, kc) of quantised vertex keys, and the vertex dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components


def edges(tris: DataFrame) -> DataFrame:
    """Three rows a triangle: (mesh_id, tri, lo, hi, forward)."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), (F.col(a) < F.col(b)).alias("forward"))
    return tris.select("mesh_id", "tri", F.explode(F.array(pair("ka", "kb"), pair("kb", "kc"), pair("kc", "ka"))).alias("e")).select("mesh_id", "tri", "e.*")


def degenerate(tris: DataFrame) -> DataFrame:
    return tris.where("ka = kb or kb = kc or kc = ka")


def non_manifold(tris: DataFrame) -> DataFrame:
    """Edges that do not belong to exactly two triangles."""
    return edges(tris).where("lo <> hi").groupBy("mesh_id", "lo", "hi").agg(F.count("*").alias("n")).where("n <> 2")


def flipped(tris: DataFrame) -> DataFrame:
    """Edges of two triangles that run it in the same direction."""
    g = edges(tris).where("lo <> hi").groupBy("mesh_id", "lo", "hi").agg(F.count("*").alias("n"), F.sum(F.col("forward").cast("int")).alias("f"), F.min("tri").alias("tri_a"), F.max("tri").alias("tri_b"))
    return g.where("n = 2 and f <> 1 and tri_a <> tri_b").select("mesh_id", "lo", "hi", "tri_a", "tri_b")


def summary(tris: DataFrame) -> DataFrame:
    vertices = tris.select("mesh_id", F.explode(F.array("ka", "kb", "kc")).alias("k")).groupBy("mesh_id").agg(F.countDistinct("k").alias("vertices"))
    base = tris.groupBy("mesh_id").agg(F.count("*").alias("triangles"), F.count_if(F.expr("ka = kb or kb = kc or kc = ka")).alias("degenerate"))
    bad, flip = (f(tris).groupBy("mesh_id").agg(F.count("*").alias(n)) for f, n in ((non_manifold, "non_manifold"), (flipped, "flipped")))
    return base.join(vertices, "mesh_id").join(bad, "mesh_id", "left").join(flip, "mesh_id", "left").na.fill(0, ["non_manifold", "flipped"])


def vertex_dictionary(tris: DataFrame) -> DataFrame:
    """(mesh_id, key, idx): keys numbered in order of their first use."""
    used = tris.select("mesh_id", "tri", F.posexplode(F.array("ka", "kb", "kc")).alias("corner", "key"))
    first = used.groupBy("mesh_id", "key").agg(F.min(F.struct("tri", "corner")).alias("at"))
    return first.select("mesh_id", "key", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("at")) - 1).alias("idx"))


def shells(tris: DataFrame) -> DataFrame:
    """(mesh_id, tri, shell, open): triangles joined over shared edges, named by their smallest; open if an edge is not of two.

    An edge links its triangles to the smallest of them, so that a busy edge gives one link a triangle and no pairs.
    """
    e = edges(tris).where("lo <> hi").select("mesh_id", "tri", "lo", "hi")
    per = e.groupBy("mesh_id", "lo", "hi").agg(F.min("tri").alias("first"), F.count("*").alias("n"))
    tied = e.join(per, ["mesh_id", "lo", "hi"])
    at = lambda t: F.struct("mesh_id", F.col(t).alias("tri"))
    roots = components(tied.select(at("tri").alias("src"), at("first").alias("dst")).distinct())
    named = roots.select("vid.mesh_id", "vid.tri", F.col("component.tri").alias("shell"))
    gaps = tied.groupBy("mesh_id", "tri").agg(F.max((F.col("n") != 2).cast("int")).alias("gap")).join(named, ["mesh_id", "tri"])
    leaks = gaps.groupBy("mesh_id", "shell").agg((F.max("gap") == 1).alias("open"))
    return named.join(leaks, ["mesh_id", "shell"]).select("mesh_id", "tri", "shell", "open")


def shell_counts(tris: DataFrame) -> DataFrame:
    """(mesh_id, shells, open_shells)"""
    per = shells(tris).groupBy("mesh_id", "shell").agg(F.max("open").alias("open"))
    return per.groupBy("mesh_id").agg(F.count("*").alias("shells"), F.count_if("open").alias("open_shells"))


def t_junctions(vertices: DataFrame, sides: DataFrame, tol: float, cell: float) -> DataFrame:
    """(mesh_id, v, x, y, z) and (mesh_id, e, ax .. bz) -> (mesh_id, v, e): vertices inside an edge, off its ends.

    A vertex is in one cell; an edge is sent to the cells of its slices of at most one cell's length and their neighbours
    within the tolerance, so the join is on cells and its output is close to the result.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    run = F.sqrt(sum((F.col(f"b{k}") - F.col(f"a{k}")) * (F.col(f"b{k}") - F.col(f"a{k}")) for k in "xyz"))
    cuts = sides.withColumn("run", run).where("run > 0").withColumn("n", F.ceil(F.col("run") / cell)).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    for k in "xyz":
        p, q = (F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * (F.col("i") - d) / F.col("n") for d in (1, 0))
        cuts = cuts.withColumn(f"c{k}", F.explode(F.sequence(at(F.least(p, q) - tol), at(F.greatest(p, q) + tol))))
    spread = cuts.select("mesh_id", "e", "run", *[f"{s}{k}" for s in "abc" for k in "xyz"]).distinct()
    near = vertices.select("mesh_id", "v", "x", "y", "z", *[at(F.col(k)).alias(f"c{k}") for k in "xyz"]).join(spread, ["mesh_id", "cx", "cy", "cz"])
    along = sum((F.col(k) - F.col(f"a{k}")) * (F.col(f"b{k}") - F.col(f"a{k}")) for k in "xyz") / F.col("run")
    near = near.withColumn("t", along).where((F.col("t") > tol) & (F.col("t") < F.col("run") - tol))
    off = sum(F.pow(F.col(k) - F.col(f"a{k}") - F.col("t") / F.col("run") * (F.col(f"b{k}") - F.col(f"a{k}")), F.lit(2)) for k in "xyz")
    return near.where(off <= tol * tol).select("mesh_id", "v", "e").distinct()
