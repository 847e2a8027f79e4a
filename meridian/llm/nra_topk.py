"""Exact top-k inner products by no-random-access aggregation over sorted component lists.

Each dimension of a block of vectors is a sorted list. A query reads its lists heaviest component first, each from the
end where its own component's sign puts the greatest products, first to the middle, then to the end: a step takes the
next ``front`` lists to the middle and those before them to the end. With every row's norm stored beside the lists, what a
row's score lacks is bounded: a list read to its middle gives the reading point as an upper bound for the rows not met,
and the lists not begun give at most the query's norm there times the norm that the row has left (Cauchy and Schwarz).
After each step the k-th best lower bound is the bar; rows whose upper bound lies below it are outsiders and cannot
qualify. A query stops once no more than an eighth of the rows, or ``few``, could still do so, and the scores of those
are resolved. A step's bounds are inner products too, so many queries of a block are bounded at once.

Components are floor(256 * x) as integers. Arithmetic is in floats where all sums stay exact, else in Python integers;
a score beyond a long is clamped to it. Defined results: vectors null or with null or non-finite components take no part;
shorter vectors count as padded with zeros; equal ids are rows of their own, but a query never meets its own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best_of, matrix, search_in_blocks, usable

def quantised(v: np.ndarray) -> tuple[np.ndarray, type]:
    """floor(256 x), and the type in which inner products of such rows are exact."""
    x = np.floor(v * 256)
    bound = float(np.abs(x).max(initial=0)) ** 2 * max(1, x.shape[1])
    if bound < 2**24:
        return x.astype(np.float32), np.float32
    if bound < 2**53:
        return x, np.float64
    return np.array([[int(c) for c in row] for row in x], object).reshape(x.shape), object


def nra_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, front: int = 8, few: int = 16, lists_read: list[int] | None = None) -> tuple[list, list, list]:
    """Best ``k`` of a block for each query row; ``x`` by rows in order of ``ids``.

    ``lists_read`` gets, for each query, how many lists were read to their end when it stopped.
    """
    n, out_q, out_i, out_s = len(ids), [], [], []
    few = max(few, 2 * k, n // 8)

    def give(row: int, places: np.ndarray, scores: np.ndarray, read: int) -> None:
        top = best_of(ids[places], scores, q_ids[row], k)
        out_q.extend([int(q_ids[row])] * len(top))
        out_i.extend(ids[places[top]].tolist())
        out_s.extend(max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores[top])
        if lists_read is not None:
            lists_read.append(read)

    active, width = np.arange(len(q_ids)), x.shape[1]
    if x.dtype == object:  # beyond the range of floats: no bounds, all lists are read
        for r in active:
            give(r, np.arange(n), x.dot(q[r]), width)
        return out_q, out_i, out_s
    lists = np.sort(x, axis=0)
    above, below = lists[n // 2], lists[(n - 1) // 2]  # reading points half way down and half way up
    met_down, met_up = x >= above, x <= below
    down, up = np.where(met_down, x, 0), np.where(met_up, x, 0)
    norm = (x * x).sum(1)
    products = np.concatenate((x, down, up), 1).T
    squares = np.concatenate((x * x, down * down, up * up), 1).T
    missed = np.concatenate((np.where(met_down, 0, above), np.where(met_up, 0, below)), 1).T
    rank = np.argsort(np.argsort(-np.abs(q), axis=1, kind="stable"), axis=1)
    for step in range(width // front + 1):
        going = []
        for at in range(0, len(active), 256):
            rows = active[at : at + 256]
            mine, r = q[rows], rank[rows]
            whole, half = r < step * front, (r >= step * front) & (r < (step + 1) * front)
            pos, neg = half & (mine > 0), half & (mine < 0)
            part = np.concatenate((mine * whole, mine * pos, mine * neg), 1) @ products
            rest = np.sqrt(np.maximum(norm - np.concatenate((whole, pos, neg), 1).astype(x.dtype) @ squares, 0))
            unread = np.sqrt(((mine * ~whole) ** 2).sum(1))[:, None] * rest
            point = np.concatenate((mine * pos, mine * neg), 1) @ missed + np.sqrt(((mine * ~(whole | half)) ** 2).sum(1))[:, None] * rest
            slack = 1 + 1e-5 * unread  # for the roots' rounding
            others = ids[None, :] != q_ids[rows][:, None]  # an id may have any number of rows
            low = np.where(others, part - unread - slack, -np.inf)
            bar = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(rows), -np.inf)
            left = others & (part + np.minimum(unread, point) + slack >= bar[:, None])
            for row, may in zip(rows, left):
                places = np.flatnonzero(may)
                if len(places) <= few or (step + 1) * front >= width:
                    give(row, places, x[places] @ q[row], min(width, step * front))
                else:
                    going.append(row)
        active = np.array(going, np.int64)
        if not len(active):
            break
    return out_q, out_i, out_s


def top_k_inner_products(df: DataFrame, is_query: Column | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score long) for each query row against all other rows."""
    rows = usable(df, id_col, vector_col)
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query

    def block(queries: pa.Table, candidates: pa.Table):
        width = max(max(map(len, t["v"].to_pylist()), default=0) for t in (queries, candidates))
        q, x = matrix(queries["v"], width), matrix(candidates["v"], width)
        both, kind = quantised(np.concatenate((q, x)))
        both = both.astype(kind)
        return nra_block(queries["vec_id"].to_numpy(), both[: len(q)], candidates["vec_id"].to_numpy(), both[len(q) :], k)

    return search_in_blocks(rows, is_query, block, k=k, score="long", block_rows=block_rows, query_rows=query_rows)
