"""Approximate nearest neighbours by cosine with additive quantisation.

Unit vectors are written as sums of one full-dimensional codeword from each of ``books`` codebooks. Codebooks are fitted
by residual clustering on a bounded sample (``sample`` rows by a hash of the id); encoding keeps the best ``beam`` partial
sums, book by book, scored from the table of codeword products. The index holds, for every row, its codes and the norm
of its approximation. A query fills a lookup table of products with all codewords; a row's estimate is the sum of its
codes' entries over the stored norm. The best ``rerank`` of each block are scored anew on the original vectors.

Estimates rank rows for reranking only; scores are exact cosines in double precision. Measured recall is in the README.
Defined results: vectors null, zero, or with null or non-finite components take no part; shorter vectors count as padded
with zeros; equal vectors tie to the smaller vec_id; with fewer than two rows there is nothing to find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import best_of, matrix, search_in_blocks, usable


class AdditiveCodebooks:
    """``books`` codebooks of up to 256 full-dimensional codewords."""

    def __init__(self, words: np.ndarray):
        self.words = words.astype(np.float32)  # book, word, dimension
        flat = self.words.reshape(-1, words.shape[-1])
        self.products = flat @ flat.T

    @classmethod
    def fit(cls, x: np.ndarray, books: int = 16, size: int = 256, rounds: int = 6, seed: int = 5) -> AdditiveCodebooks:
        rng, rest, words = np.random.default_rng(seed), x.astype(np.float32).copy(), []
        size = max(1, min(size, len(x)))
        for _ in range(books):
            centre = rest[rng.choice(len(rest), size, replace=False)].copy()
            for _ in range(rounds):
                near = (2 * rest @ centre.T - (centre * centre).sum(1)).argmax(1)
                count = np.bincount(near, minlength=size)
                order = np.argsort(near, kind="stable")
                sums = np.add.reduceat(np.concatenate((rest[order], np.zeros((1, rest.shape[1]), np.float32))), np.minimum(np.concatenate(([0], np.cumsum(count)[:-1])), len(rest)), axis=0)
                centre[count > 0] = sums[count > 0] / count[count > 0, None]
            near = (2 * rest @ centre.T - (centre * centre).sum(1)).argmax(1)
            rest -= centre[near]
            words.append(centre)
        return cls(np.array(words))

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms of the approximations), by beam search over the books."""
        books, size, _ = self.words.shape
        n, dots = len(x), (x.astype(np.float32) @ self.words.reshape(-1, x.shape[1]).T)
        own = np.diag(self.products)
        codes, loss = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for b in range(books):
            at = slice(b * size, (b + 1) * size)
            cross = np.zeros((n, codes.shape[1], size), np.float32)
            for past in range(b):
                cross += self.products[past * size + codes[:, :, past], at]
            total = loss[:, :, None] + own[at] + 2 * cross - 2 * dots[:, None, at]
            flat = total.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            parent, word = best // size, best % size
            codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]), 2)
            loss = np.take_along_axis(flat, best, 1)
        codes = codes[:, 0]
        sums = self.words[np.arange(books)[None, :], codes].sum(1)
        return codes.astype(np.uint8), np.sqrt((sums * sums).sum(1))

    def table(self, q: np.ndarray) -> np.ndarray:
        """Products of a query with every codeword: book, word."""
        return self.words @ q.astype(np.float32)


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of one vector with rows, each summed alike, so that equal rows get equal scores."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def build_index(rows: DataFrame, width: int, *, sample: int = 8192, books: int = 16, beam: int = 4) -> tuple[DataFrame, AdditiveCodebooks | None]:
    """(vec_id, v, codes, norm) of every row, and the codebooks."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()  # at most ``sample`` rows
    if not some.num_rows or not width:
        return rows.withColumn("codes", F.lit(None).cast("binary")).withColumn("norm", F.lit(None).cast("float")), None
    x = matrix(some["v"], width)
    fitted = AdditiveCodebooks.fit(x / np.sqrt((x * x).sum(1))[:, None], books)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)  # books * 256 * width floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = matrix(part.column(1), width)
                codes, norm = shared.value.encode(x / np.sqrt((x * x).sum(1))[:, None], beam)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm.astype(np.float32))], names=["vec_id", "v", "codes", "norm"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, codes binary, norm float"), fitted


def nearest(df: DataFrame, is_query: Column | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, books: int = 16, beam: int = 4, rerank: int = 160, sample: int = 8192, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score double) for each query row against all other rows."""
    rows = usable(df, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    index, fitted = build_index(rows, width, sample=sample, books=books, beam=beam)
    shared = df.sparkSession.sparkContext.broadcast(fitted)

    def block(queries: pa.Table, candidates: pa.Table):
        book, ids = shared.value, candidates["vec_id"].to_numpy()
        q, x = matrix(queries["v"], width), matrix(candidates["v"], width)
        codes = np.frombuffer(b"".join(candidates["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        norm = candidates["norm"].to_numpy()
        places = codes.T.astype(np.int64) + np.arange(codes.shape[1])[:, None] * book.words.shape[1]
        out_q, out_i, out_s = [], [], []
        for own, vector in zip(queries["vec_id"].to_pylist(), q):
            table = book.table(vector).ravel()
            guess = np.zeros(len(ids), np.float32)
            for row in places:
                guess += table[row]
            near = best_of(ids, guess / norm, own, rerank)
            near.sort()
            exact = cosine(vector, x[near])
            top = best_of(ids[near], exact, own, k)
            out_q += [own] * len(top)
            out_i += ids[near[top]].tolist()
            out_s += exact[top].tolist()
        return out_q, out_i, out_s

    return search_in_blocks(cut(index), is_query, block, k=k, score="double", block_rows=block_rows, query_rows=query_rows, extra=("v", "codes", "norm"))
