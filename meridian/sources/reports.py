"""Text reports of mesh sweeps, and the matrix of modes that a sweep builds."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the failure report, their headings, widths, and whether they stand to the right.
REPORT = [
    ("track_id", "track id", 12, False),
    ("label", "label", 28, False),
    ("mode", "mode", 30, False),
    ("part", "part", 10, False),
    ("non_manifold", "nm-edges", 8, True),
    ("degenerate", "degens", 7, True),
    ("t_junctions", "tjunc", 7, True),
    ("crossings", "selfx", 7, True),
    ("flipped", "flip", 6, True),
    ("shells", "shells", 8, True),
]
SHORTENED = ("label", "mode")


def _pad(value: Column, width: int, right: bool) -> Column:
    """Longer values stay whole."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.length(value) >= width, value).otherwise(F.lpad(value, width, " ") if right else F.rpad(value, width, " "))


def _shorten(value: Column, width: int) -> Column:
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width - 1), F.lit("…"))).otherwise(value)


def failure_lines(failures: DataFrame) -> DataFrame:
    """Rows with the report's columns, ``build_error`` and ``first_edge`` -> and ``line``."""
    cell = lambda name, width, right: _pad(_shorten(F.col(name), width) if name in SHORTENED else F.col(name), width, right)
    last = F.when(F.coalesce("build_error", F.lit("")) != "", F.concat(F.lit("BUILD ERROR: "), F.col("build_error"))).otherwise(F.coalesce("first_edge", F.lit("")))
    return failures.withColumn("line", F.concat(*[cell(n, w, r) for n, _, w, r in REPORT], F.lit("  "), last))


def failure_report(failures: DataFrame, built: int, skipped: int, requested: int, *order: str) -> DataFrame:
    """(part, n, line): head, one line a failure in ``order``, foot with totals; sort by ``part`` and ``order``'s key ``n``."""
    head = "".join(h.rjust(w) if r else h.ljust(w) for _, h, w, r in REPORT) + "  first edge"
    spark, rule = failures.sparkSession, "-" * len(head)
    key = F.struct(*order)
    body = failure_lines(failures).select(F.lit(1).alias("part"), key.alias("n"), "line")
    total = failures.agg(F.count("*").alias("rows"), F.countDistinct("track_id").alias("tracks"))
    foot = total.select(F.format_string(f"{built} tracks built, {skipped} skipped (no geometry), %d failures across %d tracks ({requested} requested)", "rows", "tracks").alias("line"))
    none = F.lit(None).cast(body.schema["n"].dataType)
    fixed = spark.createDataFrame([(-1, head), (0, rule), (2, rule)], "part int, line string")
    return fixed.select("part", none.alias("n"), "line").unionByName(body).unionByName(foot.select(F.lit(3).alias("part"), none.alias("n"), "line"))


#: Modes (coaster, inlay, shape, orientation, combined) of the two short matrices; the last ones need several layouts.
FLAT = (False, "raised", "round")
SAMPLE = [
    (*FLAT, "auto", False),
    (*FLAT, "0", False),
    (*FLAT, "90", False),
    (True, "flush", "round", "0", False),
    (True, "raised", "square", "90", False),
    (*FLAT, "auto", True),
    (True, "flush", "round", "0", True),
]
ALL = [
    (*FLAT, "auto", False),
    (*FLAT, "0", False),
    (*FLAT, "90", False),
    (True, "raised", "round", "auto", False),
    (True, "flush", "round", "auto", False),
    (True, "raised", "square", "auto", False),
    (True, "flush", "square", "auto", False),
    (True, "flush", "round", "0", False),
    (*FLAT, "auto", True),
    (True, "flush", "round", "auto", True),
    (True, "raised", "round", "auto", True),
]


def modes(variant: str) -> Column:
    """Array of structs (place, coaster, inlay, shape, orientation, combined, mode) of ``sample``, ``all`` or ``full``; at most 30."""
    bases = [FLAT, *((True, inlay, shape) for inlay, shape in product(("raised", "flush"), ("round", "square")))]
    full = [(*base, turn, combined) for combined, base, turn in product((False, True), bases, ("auto", "0", "90"))]
    rows = {"sample": SAMPLE, "all": ALL, "full": full}[variant]

    def one(place: int, coaster: bool, inlay: str, shape: str, turn: str, combined: bool) -> Column:
        kind = f"coaster-{inlay}-{shape}" if coaster else "flat"
        label = "/".join((kind, turn if turn == "auto" else f"{turn}deg", "combined" if combined else "single"))
        fields = {"place": place, "coaster": coaster, "inlay": inlay, "shape": shape, "orientation": turn, "combined": combined, "mode": label}
        return F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])

    return F.array(*[one(i, *m) for i, m in enumerate(rows)])


def sweep_plan(tracks: DataFrame, variant: str) -> DataFrame:
    """(.., layouts int) -> a row for each mode that a track is built in, combined ones only for tracks of several layouts.

    Tracks without a layout have none.
    """
    built = tracks.where("layouts > 0").select("*", F.explode(modes(variant)).alias("__mode"))
    return built.where(~F.col("__mode.combined") | (F.col("layouts") > 1)).select(*tracks.columns, "__mode.*")
