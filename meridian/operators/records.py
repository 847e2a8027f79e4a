"""Record-level operators: checked joins, votes, pages, boxes, merged tags, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_or_error(rows: DataFrame, found: DataFrame, key: str, what: str) -> DataFrame:
    """Left join; ``error`` names the key that is not there, null where it is. ``found`` has each key once."""
    hit = rows.join(found.withColumn("__hit", F.lit(True)), key, "left")
    return hit.withColumn("error", F.when(F.col("__hit").isNull(), F.concat(F.lit(f"{what} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" not found")))).drop("__hit")


def keep_or_all(rows: DataFrame, group: str, test: Column) -> DataFrame:
    """Rows that pass; all rows of a group of which none passes. Groups' flags are a partial aggregate joined back."""
    any_of = rows.groupBy(group).agg(F.max(F.coalesce(test, F.lit(False))).alias("__any"))
    return rows.join(any_of, group).where(F.coalesce(test, F.lit(False)) | ~F.col("__any")).drop("__any")


def dominant(rows: DataFrame, group: str, name: str, weight: str, share: float = 0.35) -> DataFrame:
    """(group, name, share): the name of most weight, if it has at least ``share`` of all; ties to the smaller name."""
    per = rows.groupBy(group, name).agg(F.sum(weight).alias("w"))
    best = per.groupBy(group).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(name).alias("name"))).alias("b"), F.sum("w").alias("all"))
    part = -F.col("b.w") / F.col("all")
    return best.where(part >= share).select(group, F.col("b.name").alias(name), part.alias("share"))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number``, from 0, of ``size`` rows: the order must be total. The feature is the limit."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def quarters(boxes: DataFrame) -> DataFrame:
    """(id, west, south, east, north) -> its four quarters: south-west, south-east, north-west, north-east."""
    x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    box = lambda q, w, s, e, n: F.struct(F.lit(q).alias("quarter"), w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    w, s, e, n = map(F.col, ("west", "south", "east", "north"))
    return boxes.select("id", F.explode(F.array(box(0, w, s, x, y), box(1, x, s, e, y), box(2, w, y, x, n), box(3, x, y, e, n))).alias("b")).select("id", "b.*")


def merge_tags(weak: Column, strong: Column) -> Column:
    """Both maps' tags; of a key in both, the strong one's value. Null counts as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    weak, strong = F.coalesce(weak, empty), F.coalesce(strong, empty)
    return F.map_concat(F.map_filter(weak, lambda k, v: ~F.array_contains(F.map_keys(strong), k)), strong)


def stage_times(rows: DataFrame, run: str, at: str, *order: str) -> DataFrame:
    """``seconds`` since the run's stage before; 0 at the first."""
    w = Window.partitionBy(run).orderBy(at, *order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return rows.withColumn("seconds", F.coalesce((micros - F.lag(micros).over(w)) / 1e6, F.lit(0.0)))


def sweep_summary(rows: DataFrame, group: str, track: str, state: str) -> DataFrame:
    """(group, built, skipped, failures, failed_tracks) of rows whose state is built, skipped or failed."""
    s = F.col(state)
    return rows.groupBy(group).agg(F.count_if(s == "built").alias("built"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "failed").alias("failures"), F.count_distinct(F.when(s == "failed", F.col(track))).alias("failed_tracks"))


def name_lists(rows: DataFrame, group: str, name: str) -> DataFrame:
    """(group, names): distinct non-empty names in code-unit order."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(F.when(F.trim(name) != "", F.trim(name)))).alias("names"))


def nearest_on_path(points: DataFrame, path: DataFrame) -> DataFrame:
    """(chain, v, x, y) to (chain, idx, x, y, z) -> (chain, v, z): height of the nearest place on a closed path, interpolated.

    A chain's path is one bounded array joined by key; squared distances equal to 12 places take the first segment.
    """
    line = path.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "z"))).alias("line"))
    rows = points.join(line, "chain")

    def at(p: Column, i: Column) -> Column:
        q = F.get("line", F.pmod(i + 1, F.size("line")).cast("int"))
        ux, uy = q["x"] - p["x"], q["y"] - p["y"]
        run = ux * ux + uy * uy
        t = F.when(run > 0, F.least(F.greatest(((F.col("x") - p["x"]) * ux + (F.col("y") - p["y"]) * uy) / run, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        dx, dy = p["x"] + t * ux - F.col("x"), p["y"] + t * uy - F.col("y")
        return F.struct(F.round(dx * dx + dy * dy, 12).alias("d"), i.alias("i"), (p["z"] + t * (q["z"] - p["z"])).alias("z"))

    return rows.select("chain", "v", F.array_min(F.transform("line", at))["z"].alias("z"))
