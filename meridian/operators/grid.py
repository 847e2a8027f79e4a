"""Grid operators: cells (plate, r, c, blocked), dilation, distances, prefix sums, placement scores, ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The score curve's bounds in millimetres, and its weights.
LEAST, LOW, HIGH = 2.0, 16 * 25.4 / 72, 24 * 25.4 / 72
LINE_COUNT, DAMPING = (1.0, 1.0, 0.94, 0.91), (0.75, 0.25, 0.0)


def prefix_sums(cells: DataFrame, value: Column) -> DataFrame:
    """``total``: sum over the rectangle from the plate's corner to the cell."""
    rows = Window.partitionBy("plate", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("plate", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("run", F.sum(value).over(rows)).withColumn("total", F.sum("run").over(down)).drop("run")


def dilate(cells: DataFrame, radius: int) -> DataFrame:
    """``near``: a blocked cell within ``radius`` rows and columns. Blocked cells are spread, not compared with all."""
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    spread = cells.where("blocked").select("plate", "r", "c", F.explode(reach).alias("i")).select("plate", (F.col("r") + F.col("i")).alias("r"), "c", F.explode(reach).alias("j")).select("plate", "r", (F.col("c") + F.col("j")).alias("c")).distinct()
    return cells.join(spread.withColumn("hit", F.lit(True)), ["plate", "r", "c"], "left").withColumn("near", F.coalesce("hit", F.lit(False))).drop("hit")


def distances(cells: DataFrame) -> DataFrame:
    """``dist``: king moves to the nearest blocked cell; null where a plate has none."""
    b = cells.where("blocked").select("plate", F.col("r").alias("br"), F.col("c").alias("bc"))
    d = F.greatest(F.abs(F.col("r") - F.col("br")), F.abs(F.col("c") - F.col("bc")))
    least = cells.join(b, "plate").groupBy("plate", "r", "c").agg(F.min(d).alias("dist"))
    return cells.join(least, ["plate", "r", "c"], "left")


def size_window(mm: Column) -> Column:
    """Preference for a text height: cubic rise, preferred range, linear fall, else nothing."""
    span = LOW - LEAST
    t = (mm - LEAST) / span
    return F.when(mm <= LEAST, 0.0).when(mm < LOW, t * t * t * 0.6).when(mm <= HIGH, 0.6 + 0.65 * (mm - LOW) / (HIGH - LOW)).when(mm <= HIGH + span, 1.25 * (1 - (mm - HIGH) / span)).otherwise(0.0)


def placement_score(mm: Column, lines: Column, balance: Column, outside: Column, track: Column, text: Column) -> Column:
    """Product of the six preferences of a placed text; clearances and the outside share are 0 to 1."""
    windowed = F.when(balance >= 0.7, 1.0).otherwise(balance / 0.7)
    damp = F.coalesce(F.get(F.array(*map(F.lit, DAMPING)), lines - 2), F.lit(0.0))
    even = windowed + (1 - windowed) * damp
    count = F.get(F.array(*map(F.lit, LINE_COUNT)), F.least(F.greatest(lines, F.lit(1)), F.lit(4)) - 1)
    return even * (0.25 + 0.75 * F.least(F.greatest(outside, F.lit(0.0)), F.lit(1.0))) * count * size_window(mm) * (0.92 + 0.08 * track) * (0.96 + 0.04 * F.least(text, F.lit(1.0)))


def best_of_groups(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def keep_unlike(items: Column, kind: str, alike, lookback: int | None = None) -> Column:
    """Fold over ordered items: an item stays unless it is alike to one kept (to the last ``lookback`` kept)."""
    back = lambda kept: kept if lookback is None else F.slice(kept, F.greatest(F.size(kept) - lookback + 1, F.lit(1)), F.lit(lookback))
    return F.aggregate(items, F.array().cast(kind), lambda kept, x: F.when(F.exists(back(kept), lambda k: alike(k, x)), kept).otherwise(F.array_append(kept, x)))


def fill_interior(edges: DataFrame, plates: DataFrame, cell: float) -> DataFrame:
    """(plate, x1, y1, x2, y2) rings and (plate, rows, cols) -> (plate, r, c): cells whose centre is inside, even-odd.

    Edges meet the rows whose centre line they straddle; a row's crossings are paired in order of x.
    """
    mid = lambda i: (i + 0.5) * cell
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.join(plates, "plate").where("y1 <> y2")
    first = F.greatest(F.ceil(low / cell - 0.5), F.lit(0)).cast("long")
    last = F.least(F.ceil(high / cell - 0.5) - 1, F.col("rows") - 1).cast("long")
    e = e.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("r", F.explode(F.sequence("first", "last")))
    x = F.col("x1") + (mid(F.col("r")) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    w = Window.partitionBy("plate", "r").orderBy("x", "x1", "y1", "x2", "y2")
    hit = e.withColumn("x", x).withColumn("k", F.row_number().over(w)).withColumn("until", F.lead("x").over(w)).where("k % 2 = 1 and until is not null")
    a, b = F.greatest(F.ceil(F.col("x") / cell - 0.5), F.lit(0)).cast("long"), F.least(F.ceil(F.col("until") / cell - 0.5) - 1, F.col("cols") - 1).cast("long")
    return hit.withColumn("a", a).withColumn("b", b).where("a <= b").select("plate", "r", F.explode(F.sequence("a", "b")).alias("c")).distinct()


def empty_rectangles(cells: DataFrame) -> DataFrame:
    """(plate, r1, c1, r2, c2): all rectangles of free cells that cannot grow. One plate is one task's bounded grid.

    A row's free heights go over a stack; a rectangle counts where the row below it does not extend it.
    """
    import pandas as pd

    def sweep(plate: pd.DataFrame) -> pd.DataFrame:
        grid = plate.pivot(index="r", columns="c", values="blocked").sort_index().sort_index(axis=1)
        free = (grid == False).to_numpy(bool)  # noqa: E712 - a cell that is not there is not free
        rows, cols = grid.index.to_numpy(), grid.columns.to_numpy()
        height, found = [0] * len(cols), set()
        for i in range(len(rows)):
            height = [h + 1 if f else 0 for h, f in zip(height, free[i])]
            stack: list[tuple[int, int]] = []
            for j in range(len(cols) + 1):
                now, start = (height[j] if j < len(cols) else 0), j
                while stack and stack[-1][1] >= now:
                    begin, h = stack.pop()
                    if h > now and not (i + 1 < len(rows) and free[i + 1, begin:j].all()):
                        found.add((rows[i - h + 1], cols[begin], rows[i], cols[j - 1]))
                    start = begin
                if now:
                    stack.append((start, now))
        out = pd.DataFrame(sorted(found), columns=["r1", "c1", "r2", "c2"])
        out.insert(0, "plate", plate["plate"].iloc[0])
        return out

    return cells.select("plate", "r", "c", "blocked").groupBy("plate").applyInPandas(sweep, "plate long, r1 long, c1 long, r2 long, c2 long")
