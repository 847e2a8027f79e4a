"""Dealing of vectors for searches of a stated query set against all rows, in blocks.

Both sides are dealt by a hash of their id into blocks of bounded size; a task gets one block of candidates and one of
queries and returns its best few for each query, which a partial top-k merges. Rows are moved, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of rows whose id and vector are there and whose components are all finite."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of doubles, padded with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def search_in_blocks(rows: DataFrame, is_query, block: Callable, *, k: int, score: str, block_rows: int, query_rows: int, extra: tuple[str, ...] = ("v",)) -> DataFrame:
    """(query_id, vec_id, score) of the best ``k`` for each query; ``block(queries, candidates)`` gives three arrays."""
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_blocks, n_parts = max(1, -(-counts["n"] // block_rows)), max(1, -(-counts["q"] // query_rows))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.select("vec_id", *extra)
    candidates = base.withColumn("block", deal(n_blocks, "block")).withColumn("part", every(n_parts))
    queries = rows.where(is_query).select("vec_id", *extra).withColumn("part", deal(n_parts, "part")).withColumn("block", every(n_blocks))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            empty = np.zeros(0, np.int64)
            return pa.table({"query_id": empty, "vec_id": empty, "score": pa.array([], pa.int64() if score == "long" else pa.float64())})
        q, c, s = block(right.sort_by("vec_id"), left.sort_by("vec_id"))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.int64() if score == "long" else pa.float64())})

    found = candidates.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(run, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cut(found).withColumn("rank", rank.cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def best_of(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the ``k`` best scores, ties to the smaller id (ids ascend), without ``own``."""
    ok = np.flatnonzero(ids != own)
    if len(ok) > k:
        kth = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
        ok = ok[scores[ok] >= kth]
    return ok[np.argsort(-scores[ok], kind="stable")][:k]
