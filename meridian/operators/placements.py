"""Where text goes on a plate: free rectangles, their clearance, texts fitted into them, the best by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .models import text_rank

#: Share of the smaller rectangle two may have in common, rectangles kept, likeness of two placements, how far back they are compared, placements kept.
SHARED, MOST, ALIKE, BACK, PLACED = 0.85, 150, 0.85, 3, 3
#: Fixed value: millimetres of the highest line that is wanted.
TALLEST = grid.HIGH


def clearances(rects: DataFrame, cells: DataFrame) -> DataFrame:
    """(plate, rect, r1, c1, r2, c2) with ``clearance``, the least ``dist`` (plate, r, c, dist) of its cells, and ``edge``, of its border's; 0 without any.

    Rectangles are spread over their rows, so cells join by (plate, row); a row's least distance is a partial aggregate.
    """
    rows = rects.select("plate", "rect", "r1", "c1", "r2", "c2", F.explode(F.sequence("r1", "r2")).alias("r"))
    hit = rows.join(cells.select("plate", "r", "c", "dist"), ["plate", "r"]).where("c between c1 and c2")
    border = (F.col("r") == F.col("r1")) | (F.col("r") == F.col("r2")) | (F.col("c") == F.col("c1")) | (F.col("c") == F.col("c2"))
    least = hit.groupBy("plate", "rect").agg(F.min("dist").alias("clearance"), F.min(F.when(border, F.col("dist"))).alias("edge"))
    return rects.join(least, ["plate", "rect"], "left").na.fill(0, ["clearance", "edge"])


def rank_rectangles(rects: DataFrame) -> DataFrame:
    """``place`` from 0 on each plate: greatest area, then squareness, top, left."""
    w, h = F.col("c2") - F.col("c1") + 1, F.col("r2") - F.col("r1") + 1
    order = Window.partitionBy("plate").orderBy((-w * h), F.abs(w - h), "r1", "c1")
    return rects.withColumn("place", (F.row_number().over(order) - 1).cast("int"))


def unlike_rectangles(rects: DataFrame, most: int = MOST, shared: float = SHARED) -> DataFrame:
    """(plate, place, r1, c1, r2, c2) ranked -> those of which no better one shares over 85 % of the smaller, the first ``most`` (the limit is the feature)."""
    rows = rects.groupBy("plate").agg(F.array_sort(F.collect_list(F.struct("place", "r1", "c1", "r2", "c2"))).alias("items"))
    kind = rows.schema["items"].dataType.simpleString()
    span = lambda a, b, lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]) + 1, F.lit(0))
    area = lambda a: (a["r2"] - a["r1"] + 1) * (a["c2"] - a["c1"] + 1)
    alike = lambda a, b: span(a, b, "r1", "r2") * span(a, b, "c1", "c2") / F.least(area(a), area(b)) > shared
    kept = F.slice(grid.keep_unlike(F.col("items"), kind, alike), 1, most)
    return rows.select("plate", F.posexplode(kept).alias("candidate", "x")).select("plate", "candidate", "x.*")


def fitted(width: Column, height: Column, text_width: Column, text_height: Column, line_height: Column) -> Column:
    """The scale at which a text fills a rectangle and no line is higher than wanted; null where lines get too low to read."""
    scale = F.least(width / text_width, height / text_height, TALLEST / line_height)
    return F.when(scale * line_height >= grid.LEAST, scale)


def best_fits(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """(plate, candidate, width, height, outside, clearance 0..1) with each line count of its plate's text (plate, lines, text_width, text_height, line_height, balance) -> the best of each candidate, ranked.

    Ties go to fewer lines, then to the smaller candidate. A plate's few texts meet its candidates by an equi-join.
    """
    rows = candidates.join(texts, "plate").withColumn("scale", fitted(*map(F.col, ("width", "height", "text_width", "text_height", "line_height")))).where("scale is not null")
    score = grid.placement_score(F.col("scale") * F.col("line_height"), F.col("lines"), F.col("balance"), F.col("outside"), F.col("clearance"), F.coalesce(F.col("text_clearance"), F.lit(1.0)) if "text_clearance" in candidates.columns else F.lit(1.0))
    names = [c for c in (*candidates.columns, "lines", "scale", "score") if c not in ("plate", "candidate")]
    best = rows.withColumn("score", score).groupBy("plate", "candidate").agg(F.min_by(F.struct(*names), F.struct(-F.col("score"), F.col("lines"))).alias("b")).select("plate", "candidate", "b.*")
    return best.withColumn("place", (F.row_number().over(Window.partitionBy("plate").orderBy(F.desc("score"), "candidate")) - 1).cast("int"))


def unlike_placements(ranked: DataFrame, diagonal: str = "diagonal", most: int | None = PLACED) -> DataFrame:
    """(plate, place, candidate, x, y, lines, scale, score, diagonal) ranked -> those unlike the last three kept, the first ``most``: lines, centre and scale count alike."""
    item = F.struct("place", "candidate", "x", "y", "lines", "scale", "score")
    rows = ranked.groupBy("plate").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first(diagonal).alias("diagonal"))
    kind = rows.schema["items"].dataType.simpleString()
    reach = F.when(F.col("diagonal") > 0, F.col("diagonal")).otherwise(1.0) / 2

    def alike(a: Column, b: Column) -> Column:
        far = F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
        sizes = F.when((a["scale"] > 0) & (b["scale"] > 0), F.least(a["scale"], b["scale"]) / F.greatest(a["scale"], b["scale"])).otherwise(1.0)
        return ((a["lines"] == b["lines"]).cast("int") + F.greatest(F.lit(0.0), 1 - far / reach) + sizes) / 3 > ALIKE

    kept = grid.keep_unlike(F.col("items"), kind, alike, BACK)
    kept = kept if most is None else F.slice(kept, 1, most)
    return rows.select("plate", F.posexplode(kept).alias("rank", "p")).select("plate", (F.col("rank") + 1).alias("rank"), "p.candidate", "p.lines", "p.scale", "p.score")


def pick(placements: Column, rank: Column) -> Column:
    """The placement of a rank from 1; the last one for ranks beyond."""
    return F.get(placements, (F.least(text_rank(rank), F.size(placements).cast("long")) - 1).cast("int"))


def ranked_placements(cells: DataFrame, plates: DataFrame, texts: DataFrame) -> DataFrame:
    """(plate, r, c, blocked, outside), (plate, rows, cols, cell_w, cell_h), texts -> (plate, rank, candidate, lines, scale, score): from free rectangles to unlike placements."""
    rects = grid.empty_rectangles(cells)
    rects = rects.withColumn("rect", F.concat_ws(",", "r1", "c1", "r2", "c2"))
    spread = clearances(rects, grid.distances(cells)).join(plates, "plate")
    chosen = unlike_rectangles(rank_rectangles(rects))
    inside = chosen.select("plate", "candidate", "c1", "c2", F.explode(F.sequence("r1", "r2")).alias("r")).join(cells.select("plate", "r", "c", "outside"), ["plate", "r"]).where("c between c1 and c2")
    share = inside.groupBy("plate", "candidate").agg(F.avg(F.col("outside").cast("double")).alias("outside"))
    free = F.least(F.lit(1.0), F.col("clearance") / F.greatest(F.col("rows") - 1, F.col("cols") - 1, F.lit(1)))
    sized = chosen.join(spread, ["plate", "r1", "c1", "r2", "c2"]).join(share, ["plate", "candidate"])
    sized = sized.select("plate", "candidate", ((F.col("c2") - F.col("c1") + 1) * F.col("cell_w")).alias("width"), ((F.col("r2") - F.col("r1") + 1) * F.col("cell_h")).alias("height"), "outside", free.alias("clearance"), ((F.col("c1") + F.col("c2") + 1) / 2 * F.col("cell_w")).alias("x"), ((F.col("r1") + F.col("r2") + 1) / 2 * F.col("cell_h")).alias("y"), F.sqrt((F.col("rows") * F.col("cell_h")) ** 2 + (F.col("cols") * F.col("cell_w")) ** 2).alias("diagonal"))
    return unlike_placements(best_fits(sized, texts))
