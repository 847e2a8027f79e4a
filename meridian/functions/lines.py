"""Breaking a name into lines of even width."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: A lone last word under this share of the target width, and what it costs.
ORPHAN_SHARE, ORPHAN_WEIGHT = 0.65, 10.0


def break_lines(words: list[str], count: int, widths: list[float], space: float) -> list[str]:
    """Lines of least squared deviation from the mean width; of equal splits, that with the last line longest.

    Row m of the table has the least cost of the first j words in m lines. Widths come from one running sum.
    """
    n = len(words)
    if count <= 1 or n <= 1:
        return [" ".join(words)]
    if count >= n:
        return list(words)
    ends = np.concatenate([[0.0], np.cumsum(np.asarray(widths, float) + space)])
    target = (ends[n] - space) / count
    cost = np.full(n + 1, np.inf)
    cost[1:] = (target - (ends[1:] - space)) ** 2
    came = []
    for m in range(2, count + 1):
        wide = ends[None, :] - ends[:, None] - space  # from word i up to word j
        step = (target - wide) ** 2
        if m == count and target > 0 and wide[n - 1, n] / target < ORPHAN_SHARE:
            step[n - 1, n] += ORPHAN_WEIGHT * target * target
        i, j = np.indices(step.shape)
        total = np.where((i >= m - 1) & (i < j), cost[:, None] + step, np.inf)
        came.append(total.argmin(0))
        cost = total.min(0)
    cuts = [n]
    for row in reversed(came):
        cuts.append(int(row[cuts[-1]]))
    cuts = [0, *reversed(cuts)]
    return [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]


def lines_of(count: int, most: int = 4):
    """Column function: text -> lines, one unit a character and one a space; at most ``most`` lines. Null: no lines."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            words = (text or "").split()
            return break_lines(words, max(1, min(count, most, len(words))), [float(len(w)) for w in words], 1.0) if words else []

        return texts.map(one)

    return run
