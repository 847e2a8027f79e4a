"""Placements end to end, chains cleaned and arrays of rings against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from meridian.operators import circuits, grid, models, placements, routes


def brute_placements(blocked, outside, rows, cols, cell_w, cell_h, texts):
    """Free rectangles that cannot grow, ranked, thinned, each with its best text, thinned again."""
    free = lambda r1, c1, r2, c2: r1 >= 0 and c1 >= 0 and r2 < rows and c2 < cols and not any((r, c) in blocked for r in range(r1, r2 + 1) for c in range(c1, c2 + 1))
    rects = [x for x in itertools.product(range(rows), range(cols), range(rows), range(cols)) if x[0] <= x[2] and x[1] <= x[3] and free(*x)]
    rects = [x for x in rects if not any(free(x[0] - a, x[1] - b, x[2] + c, x[3] + d) for a, b, c, d in ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)))]
    size = lambda x: (x[2] - x[0] + 1, x[3] - x[1] + 1)
    area = lambda x: size(x)[0] * size(x)[1]
    rects.sort(key=lambda x: (-area(x), abs(size(x)[0] - size(x)[1]), x[0], x[1]))
    kept = []
    for x in rects:
        common = lambda y: max(0, min(x[2], y[2]) - max(x[0], y[0]) + 1) * max(0, min(x[3], y[3]) - max(x[1], y[1]) + 1)  # noqa: B023, E731
        if all(common(y) / min(area(x), area(y)) <= 0.85 for y in kept):
            kept.append(x)
    found = []
    for n, x in enumerate(kept):
        cells = list(itertools.product(range(x[0], x[2] + 1), range(x[1], x[3] + 1)))
        clear = min(max(abs(r - a), abs(c - b)) for r, c in cells for a, b in blocked) / max(rows - 1, cols - 1)
        share = sum(cell in outside for cell in cells) / len(cells)
        height, width = size(x)[0] * cell_h, size(x)[1] * cell_w
        fits = []
        for lines, w, h, line, balance in texts:
            scale = min(width / w, height / h, grid.HIGH / line)
            mm = scale * line
            if mm < 2:
                continue
            t = (mm - 2) / (grid.LOW - 2)
            curve = 0.0 if mm <= 2 else t**3 * 0.6 if mm < grid.LOW else 0.6 + 0.65 * (mm - grid.LOW) / (grid.HIGH - grid.LOW)
            even = min(1.0, balance / 0.7)
            even += (1 - even) * {2: 0.75, 3: 0.25}.get(lines, 0.0)
            fits.append((-(even * (0.25 + 0.75 * share) * grid.LINE_COUNT[lines - 1] * curve * (0.92 + 0.08 * min(1, clear))), lines, scale))
        if fits:
            score, lines, scale = min(fits)
            found.append((score, n, lines, scale, (x[1] + x[3] + 1) / 2 * cell_w, (x[0] + x[2] + 1) / 2 * cell_h))
    found.sort()
    reach, out = ((rows * cell_h) ** 2 + (cols * cell_w) ** 2) ** 0.5 / 2, []
    for p in found:
        like = lambda q: ((p[2] == q[2]) + max(0, 1 - ((p[4] - q[4]) ** 2 + (p[5] - q[5]) ** 2) ** 0.5 / reach) + min(p[3], q[3]) / max(p[3], q[3])) / 3 > 0.85  # noqa: B023, E731
        if not any(map(like, out[-3:])):
            out.append(p)
    return [(k + 1, p[1], p[2], round(p[3], 6), round(-p[0], 6)) for k, p in enumerate(out[:3])]


def test_ranked_placements(spark):
    rng = random.Random(5)
    cells, want = [], {}
    texts = [(1, 40.0, 4.0, 3.0, 1.0), (2, 20.0, 8.0, 3.0, 0.6), (3, 14.0, 12.0, 3.0, 0.9)]
    for plate in range(3):
        grid_ = list(itertools.product(range(7), range(6)))
        blocked, outside = set(rng.sample(grid_, 6)), set(rng.sample(grid_, 20))
        cells += [(plate, r, c, (r, c) in blocked, (r, c) in outside) for r, c in grid_]
        want[plate] = brute_placements(blocked, outside, 7, 6, 6.0, 5.0, texts)
    df = spark.createDataFrame(cells, "plate long, r long, c long, blocked boolean, outside boolean")
    plates = spark.createDataFrame([(p, 7, 6, 6.0, 5.0) for p in range(3)], "plate long, rows long, cols long, cell_w double, cell_h double")
    words = spark.createDataFrame([(p, *t) for p in range(3) for t in texts], "plate long, lines int, text_width double, text_height double, line_height double, balance double")
    got = {}
    for r in placements.ranked_placements(df, plates, words).orderBy("plate", "rank").collect():
        got.setdefault(r.plate, []).append((r["rank"], r.candidate, r.lines, round(r.scale, 6), round(r.score, 6)))
    assert got == want


def test_cleaned_chains(spark):
    rng = random.Random(6)
    rows = [(i, [(50 + rng.randint(0, 6) / 1e4, 5 + rng.randint(0, 6) / 1e4) for _ in range(rng.randint(0, 25))]) for i in range(30)] + [(99, None)]
    got = {r.chain: r.nodes for r in circuits.cleaned_chains(spark.createDataFrame(rows, "chain long, nodes array<struct<lat:double,lon:double>>")).collect()}
    for k, nodes in rows:
        if nodes is None:
            assert got[k] is None
            continue
        once, changed = [], True  # repeats and backtracks gone one sweep after the other, by the predicates alone
        for p in nodes:
            if not once or routes.apart(once[-1], p) >= routes.EXACT:
                once.append(p)
        while changed and len(once) >= 3:
            sweep = once[:1]
            for i in range(1, len(once) - 1):
                if not routes.is_backtrack(sweep[-1], once[i], once[i + 1]):
                    sweep.append(once[i])
            sweep.append(once[-1])
            changed = len(sweep) < len(once)
            once = [p for i, p in enumerate(sweep) if i == 0 or routes.apart(sweep[i - 1], p) >= routes.EXACT]
        want = routes.closed_if_near(routes.turn_reversed_sections(once))
        assert [tuple(p) for p in got[k]] == want


def test_rings_and_errors(spark):
    ring = lambda points: spark.createDataFrame([(points,)], "p array<struct<x:double,y:double>>").select(models.ring(F.col("p"))).first()[0]
    a, b, c = (0.0, 0.0), (1.0, 0.0), (1.0, 1.0)
    assert [tuple(p) for p in ring([a, a, b, (float("nan"), 1.0), b, c, a])] == [a, b, c]
    for bad in ([a, b], [a, a, b, b], None):
        with pytest.raises(Exception, match="three"):
            ring(bad)
