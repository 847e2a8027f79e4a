"""Plates as grids of cells: their dimensions, outlines drawn on them, and the cells that text may not use.

Everything is worked out in units of cells, so that one set of formulas holds for every plate. All keys are equi-joins;
a plate's cells are bounded by its size. ``text_mask`` makes them in Arrow batches of whole plates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grid

#: Least side of a cell in millimetres, least cells a side, shortest plate side with a margin about obstacles.
CELL_MM, LEAST_CELLS, WIDE_MM = 2, 8, 80
#: Cells that a task masks at once; a larger plate is masked alone.
AT_ONCE = 500_000


def dimensions(plates: DataFrame) -> DataFrame:
    """(plate, x0, y0, width, height) -> and ``rows``, ``cols``, ``cell_w``, ``cell_h``, ``margin`` (cells about obstacles)."""
    longest, shortest = F.greatest("width", "height"), F.least("width", "height")
    many = F.greatest(F.floor(longest / CELL_MM), F.lit(LEAST_CELLS)).cast("long")
    few = F.greatest(F.floor(shortest / (longest / many) + 0.5), F.lit(LEAST_CELLS)).cast("long")
    wide = F.col("width") >= F.col("height")
    rows, cols = F.when(wide, few).otherwise(many), F.when(wide, many).otherwise(few)
    sized = plates.withColumn("rows", rows).withColumn("cols", cols)
    return sized.withColumn("cell_w", F.col("width") / F.col("cols")).withColumn("cell_h", F.col("height") / F.col("rows")).withColumn("margin", F.when(shortest >= WIDE_MM, 1).otherwise(0))


def cells(dims: DataFrame) -> DataFrame:
    """(plate, r, c) of all cells."""
    return dims.select("plate", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r")).select("plate", "r", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))


def sides(rings: DataFrame) -> DataFrame:
    """(.., points array<struct<x, y>>) -> a row for each side (x1, y1, x2, y2) of rings of three points or more."""
    point = lambda i: F.get("points", F.pmod(i, F.size("points")).cast("int"))
    rest = [c for c in rings.columns if c != "points"]
    cut = rings.where(F.size("points") >= 3).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("points") - 1)))
    return cut.select(*rest, point(F.col("i") - 1)["x"].alias("x1"), point(F.col("i") - 1)["y"].alias("y1"), point(F.col("i"))["x"].alias("x2"), point(F.col("i"))["y"].alias("y2"))


def in_cells(edges: DataFrame, dims: DataFrame) -> DataFrame:
    """Sides (plate, .., x1, y1, x2, y2) in units of their plate's cells, from its corner."""
    to = lambda v, axis: ((F.col(v) - F.col("x0" if axis == "w" else "y0")) / F.col(f"cell_{axis}")).alias(v)
    rest = [c for c in edges.columns if c not in ("x1", "y1", "x2", "y2")]
    return edges.join(dims.select("plate", "x0", "y0", "cell_w", "cell_h"), "plate").select(*rest, to("x1", "w"), to("y1", "h"), to("x2", "w"), to("y2", "h"))


def touched(edges: DataFrame, dims: DataFrame) -> DataFrame:
    """Sides in cell units -> (plate, r, c) that a side passes through: its part in each row spans the row's cells."""
    at = lambda v: F.floor(v).cast("long")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    flat = high - low < 1e-12
    e = edges.join(dims.select("plate", "rows", "cols"), "plate").withColumn("flat", flat)
    held = F.least(F.greatest(at(F.col("y1")), F.lit(0)), F.col("rows") - 1)
    e = e.withColumn("first", F.when(F.col("flat"), held).otherwise(F.greatest(at(low), F.lit(0)))).withColumn("last", F.when(F.col("flat"), held).otherwise(F.least(at(high), F.col("rows") - 1)))
    e = e.where("first <= last").withColumn("r", F.explode(F.sequence("first", "last")))
    x = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    p = F.when(F.col("flat"), F.col("x1")).otherwise(x(F.greatest(low, F.col("r"))))
    q = F.when(F.col("flat"), F.col("x2")).otherwise(x(F.least(high, F.col("r") + 1)))
    e = e.withColumn("a", F.greatest(at(F.least(p, q)), F.lit(0))).withColumn("b", F.least(at(F.greatest(p, q)), F.col("cols") - 1)).where("a <= b")
    return e.select("plate", "r", F.explode(F.sequence("a", "b")).alias("c")).distinct()


def outline_cells(rings: DataFrame, dims: DataFrame) -> DataFrame:
    """(plate, outline, ring, points) -> (plate, outline, r, c): cells of ring 0 and its border, without those inside another ring and off its border."""
    kept = rings.where(F.size("points") >= 3)
    key = F.struct("plate", "outline", "ring").alias("plate")
    lines = in_cells(sides(kept), dims).select(key, "x1", "y1", "x2", "y2")
    room = kept.join(dims, "plate").select(key, "rows", "cols")
    inside, border = grid.fill_interior(lines, room, 1.0), touched(lines, room)
    hole = F.col("plate.ring") > 0
    body = inside.where(~hole).unionByName(border.where(~hole)).select("plate.plate", "plate.outline", "r", "c").distinct()
    bored = inside.where(hole).join(border.where(hole), ["plate", "r", "c"], "left_anti").select("plate.plate", "plate.outline", "r", "c").distinct()
    return body.join(bored, ["plate", "outline", "r", "c"], "left_anti")


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of every whole number from ``first`` to ``last`` of each."""
    n = np.maximum(last - first + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, first[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]


def _whole(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -1e15, 1e15).astype(np.int64)


class _Canvases:
    """Grids of cells end to end, each of a plate's size, and sides on them in cell units."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray):
        self.rows, self.cols = rows, cols
        self.begin = np.concatenate([[0], np.cumsum(rows * cols)])

    def marked(self, canvas: np.ndarray, r: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cells from column ``a`` to ``b`` of row ``r``."""
        canvas, r, a, b = (x[a <= b] for x in (canvas, r, a, b))
        at, n = self.begin[canvas] + r * self.cols[canvas], self.begin[-1] + 1
        return np.cumsum(np.bincount(at + a, minlength=n) - np.bincount(at + b + 1, minlength=n))[:-1] > 0

    def inside(self, canvas: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """As ``grid.fill_interior``."""
        x1, y1, x2, y2 = sides
        first = np.maximum(_whole(np.ceil(np.minimum(y1, y2) - 0.5)), 0)
        last = np.minimum(_whole(np.ceil(np.maximum(y1, y2) - 0.5)) - 1, self.rows[canvas] - 1)
        s, r = _ranges(first, np.where(y1 == y2, first - 1, last))
        x, on = x1[s] + (r + 0.5 - y1[s]) * (x2[s] - x1[s]) / (y2[s] - y1[s]), canvas[s]
        by = np.lexsort((x, r, on))
        x, r, on = x[by], r[by], on[by]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (on[1:] != on[:-1])]) if len(x) else np.zeros(0, bool)
        place = np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(x) else np.zeros(0, np.int64)
        k = np.flatnonzero((place[:-1] % 2 == 0) & ~new[1:])
        a, b = np.maximum(_whole(np.ceil(x[k] - 0.5)), 0), np.minimum(_whole(np.ceil(x[k + 1] - 0.5)) - 1, self.cols[on[k]] - 1)
        return self.marked(on[k], r[k], a, b)

    def border(self, canvas: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """As ``touched``."""
        x1, y1, x2, y2 = sides
        low, high, most = np.minimum(y1, y2), np.maximum(y1, y2), self.rows[canvas] - 1
        flat = high - low < 1e-12
        held = np.minimum(np.maximum(_whole(np.floor(y1)), 0), most)
        s, r = _ranges(np.where(flat, held, np.maximum(_whole(np.floor(low)), 0)), np.where(flat, held, np.minimum(_whole(np.floor(high)), most)))
        x1, y1, x2, y2, low, high, flat, on = (v[s] for v in (x1, y1, x2, y2, low, high, flat, canvas))
        slope = np.where(flat, 1.0, y2 - y1)
        x = lambda y: x1 + (x2 - x1) * (y - y1) / slope
        p, q = np.where(flat, x1, x(np.maximum(low, r))), np.where(flat, x2, x(np.minimum(high, r + 1)))
        return self.marked(on, r, np.maximum(_whole(np.floor(np.minimum(p, q))), 0), np.minimum(_whole(np.floor(np.maximum(p, q))), self.cols[on] - 1))

    def over(self, marks: np.ndarray, to: np.ndarray, other: _Canvases) -> np.ndarray:
        """Cells of the canvases ``to`` of others that are marked on any canvas that goes there."""
        at = np.flatnonzero(marks)
        canvas = np.searchsorted(self.begin, at, "right") - 1
        out = np.zeros(other.begin[-1], bool)
        out[at - self.begin[canvas] + other.begin[to[canvas]]] = True
        return out


def _sides(points: pa.ListArray, plate: np.ndarray, frame: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ring, sides in cell units) of rings of three points or more; ``plate``: that of each ring."""
    n = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = points.flatten()
    x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
    ring = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    at = np.arange(len(ring))
    before = np.where(at == begin[ring], at + n[ring] - 1, at - 1)
    on = plate[ring]
    with np.errstate(all="ignore"):
        x, y = (x - frame["x0"][on]) / frame["cell_w"][on], (y - frame["y0"][on]) / frame["cell_h"][on]
    sides = np.stack([x[before], y[before], x, y])
    good = (n[ring] >= 3) & ~np.isnan(sides).any(axis=0)
    return ring[good], sides[:, good]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(row, item) of all items."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), column.flatten()


def masked(t: pa.RecordBatch) -> pa.RecordBatch:
    """The cells of whole plates, all at once; see ``text_mask``."""
    frame = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "width", "height", "rows", "cols", "cell_w", "cell_h", "margin", "round")}
    every = _Canvases(frame["rows"], frame["cols"])
    plate, rings = _lists(t.column("rings"))
    ring, sides = _sides(rings.field("points"), plate, frame)
    # One canvas for each ring of an outline: what is inside of it and on its border is told from other rings.
    number, outline = rings.field("ring").fill_null(0).to_numpy(zero_copy_only=False), rings.field("outline").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    keys, group = np.unique(np.stack([plate, outline, number])[:, ring], axis=1, return_inverse=True)
    group = group.ravel()
    shapes, which = np.unique(keys[:2], axis=1, return_inverse=True)
    which = which.ravel()
    own, outlines = _Canvases(frame["rows"][keys[0]], frame["cols"][keys[0]]), _Canvases(frame["rows"][shapes[0]], frame["cols"][shapes[0]])
    inside, border = own.inside(group, sides), own.border(group, sides)
    hole = np.repeat(keys[2] > 0, own.rows * own.cols)
    body, bored = own.over((inside | border) & ~hole, which, outlines), own.over(inside & ~border & hole, which, outlines)
    drawn = outlines.over(body & ~bored, shapes[0], every)
    on, points = _lists(t.column("primary"))
    ring, sides = _sides(points, on, frame)
    inner = every.inside(on[ring], sides)
    p = np.repeat(np.arange(t.num_rows), every.rows * every.cols)
    rows, cols = every.rows[p], every.cols[p]
    r, c = np.divmod(np.arange(len(p)) - every.begin[p], cols)
    near, margin = drawn.copy(), frame["margin"][p]
    reach = int(frame["margin"].max(initial=0))
    for i in range(-reach, reach + 1):
        for j in range(-reach, reach + 1):
            at = np.flatnonzero(drawn & (margin >= max(abs(i), abs(j)))) if i or j else np.zeros(0, np.int64)
            at = at[(r[at] + i >= 0) & (r[at] + i < rows[at]) & (c[at] + j >= 0) & (c[at] + j < cols[at])]
            near[at + i * cols[at] + j] = True
    blocked = near | (r < 1) | (c < 1) | (r >= rows - 1) | (c >= cols - 1)
    if frame["round"].any():
        x, y = frame["x0"][p] + (c + 0.5) * frame["cell_w"][p], frame["y0"][p] + (r + 0.5) * frame["cell_h"][p]
        half = (np.minimum(frame["width"], frame["height"]) / 2)[p]
        blocked |= frame["round"][p] & (x * x + y * y > half * half)
    return pa.RecordBatch.from_arrays([t.column("plate").take(pa.array(p)), *map(pa.array, (r, c, drawn, blocked, ~inner))], names=["plate", "r", "c", "obstacle", "blocked", "outside"])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = b.column("rows").to_numpy() * b.column("cols").to_numpy()
        at = 0
        while at < b.num_rows:
            n = max(int(np.searchsorted(np.cumsum(size[at:]), AT_ONCE, "right")), 1)
            yield masked(b.slice(at, n))
            at += n


def text_mask(rings: DataFrame, primary: DataFrame, dims: DataFrame, round_plate: Column | None = None) -> DataFrame:
    """(plate, r, c, obstacle, blocked, outside) of all cells.

    ``obstacle``: in an outline of ``rings``; ``blocked``: within the plate's margin of one, on the plate's rim, or off the
    circle of a round plate; ``outside``: centre not in the ring of ``primary`` (plate, points).
    A plate and its rings meet in one row, by merge joins, and its cells are made there: none is moved or kept.
    """
    number = lambda c, kind: F.col(c).cast(kind).alias(c)
    own = rings.where("ring is not null and not (ring > 0 and outline is null)").select("plate", F.struct("outline", "ring", F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("points")).alias("ring"))
    own = own.groupBy("plate").agg(F.collect_list("ring").alias("rings"))
    first = primary.select("plate", F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("points")).groupBy("plate").agg(F.collect_list("points").alias("primary"))
    flag = F.lit(False) if round_plate is None else F.coalesce(round_plate, F.lit(False))
    frame = dims.where("rows > 0 and cols > 0").select("plate", *[number(c, "double") for c in ("x0", "y0", "width", "height", "cell_w", "cell_h")], number("rows", "long"), number("cols", "long"), F.coalesce("margin", F.lit(0)).cast("long").alias("margin"), flag.alias("round"))
    every = frame.hint("merge").join(own.hint("merge"), "plate", "left").join(first.hint("merge"), "plate", "left")
    none = [F.coalesce(c, F.array().cast(every.schema[c].dataType)).alias(c) for c in ("rings", "primary")]
    kind = dims.schema["plate"].dataType.simpleString()
    return every.select(*frame.columns, *none).mapInArrow(_mask, f"plate {kind}, r bigint, c bigint, obstacle boolean, blocked boolean, outside boolean")
