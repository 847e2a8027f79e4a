"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits, each padded with zeros to a 23-bit word of the perfect
binary Golay code. A word is decoded to the codewords within distance 4: its own one, and where that lies at distance 3
five more. If two words differ in at most one bit, the codeword that one decodes to is in the other's list. Three errors
over three segments leave at most one error in each of the two best segments (pigeonhole), so two linked fingerprints
meet on the pair of codeword indices of those two segments. One side of the join carries its own indices only (3 keys),
the other its lists (3 to 108 keys). The Hamming distance is verified inside the join.

Defined results: null or wordless text has fingerprint 0 and links as any other; equal rows stay rows; null doc_id takes
part in components but never names one unless all of its component's ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, cut, heavy_join, row_key, whole_row

#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0xC75
SEGMENTS = ((0, 21), (21, 21), (42, 22))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits over the XXH64 of all shingles, as an unsigned 64-bit number."""
    import xxhash

    tokens = text.encode().translate(LOWER).split() if text else []
    if not tokens:
        return 0
    digest, line = xxhash.xxh64_digest, b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        joined = b"".join([digest(line[s:e], seed) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])])
        counts += np.unpackbits(np.frombuffer(joined, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. One pass, no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator of 23-bit words."""
    out = np.zeros(len(words), np.int64)
    for bit in range(23):
        rest = 1 << bit
        for high in range(22, 10, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - 11)
        out ^= np.where(words >> bit & 1, rest, 0)
    return out


@cache
def coset_patterns(radius: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight up to ``radius``, lightest first, and how many there are."""
    patterns = np.zeros(1, np.int64)
    by_weight = [patterns]
    for _ in range(radius):
        patterns = np.unique((patterns[:, None] | (1 << np.arange(23))[None, :]).ravel())
        patterns = np.setdiff1d(patterns, np.concatenate(by_weight))
        by_weight.append(patterns)
    every = np.concatenate(by_weight)
    syn = syndrome(every)
    order = np.argsort(syn, kind="stable")
    every, syn = every[order], syn[order]
    count = np.bincount(syn, minlength=2048)
    table = np.zeros((2048, count.max()), np.int64)
    table[syn, np.arange(len(syn)) - np.concatenate(([0], np.cumsum(count)[:-1]))[syn]] = every
    return table, count


def segment_indices(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each segment: codeword indices (12 bits) by row, the word's own first, and how many are valid."""
    table, count = coset_patterns()
    out = []
    for shift, width in SEGMENTS:
        word = (fp >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        syn = syndrome(word)
        out.append(((word[:, None] ^ table[syn]) >> 11, count[syn]))
    return out


def golay_keys(fp: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): of each pair of segments both codeword indices; the decoded ones only, or all in the lists."""
    segments, rows, keys = segment_indices(fp), [], []
    at = np.arange(len(fp))
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, na), (b, nb) = segments[i], segments[j]
        for x in range(1 if own else a.shape[1]):
            for y in range(1 if own else b.shape[1]):
                ok = (na > x) & (nb > y)
                rows.append(at[ok])
                keys.append(tag << 24 | a[ok, x] << 12 | b[ok, y])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(distinct: DataFrame, own: bool, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 8192):
                part = fp[at : at + 8192]
                rows, keys = golay_keys(part.view(np.uint64), own)
                yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(keys.astype(np.int32))], names=[name, "code"])

    return distinct.select("fp").mapInArrow(run, f"{name} long, code int")


def linked_fingerprints(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (src, dst) of different fingerprints at ``max_bits`` or fewer differing bits; each pair at least once."""
    if max_bits > 3:
        raise ValueError("two good segments are certain up to 3 differing bits only")
    a, b = keyed(distinct, True, "src"), keyed(distinct, False, "dst")
    near = F.expr(f"src < dst and bit_count(src ^ dst) <= {max_bits}")
    return a.join(b, (a.code == b.code) & near).select("src", "dst")


def fingerprint_components(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, low, ...), one row per distinct fingerprint -> and (root, component_id): the smallest fingerprint and ``low`` reachable."""
    roots = connected_components(linked_fingerprints(distinct, max_bits))
    members = cut(distinct.join(roots, distinct.fp == roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "fp")))
    lowest = cut(members.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("size")))
    return heavy_join(members, lowest, ["root"], "size", members.count()).drop("size")


def near_duplicate_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Equal fingerprints collapse before the join; links are sought among distinct ones only.
    """
    marks = cut(fingerprints(df, id_col=id_col, text_col=text_col, words=words))
    distinct = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    named = cut(fingerprint_components(distinct, max_bits).select("fp", "n", "component_id"))
    return heavy_join(marks, named, ["fp"], "n", marks.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``df`` with one left of each component: that of the smallest id (then text hash, then row hash); columns of any name pass through."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(F.lit(1), text).alias("g"), F.xxhash64(F.lit(2), text).alias("h"))
    rows = df.select(at.alias("at"), F.col(text_col).alias("text"), row_key(df).alias("key"), whole_row(df).alias("row"))
    marks = fingerprints(rows, id_col="at", text_col="text", words=words).withColumnRenamed("doc_id", "at")
    distinct = cut(marks.groupBy("fp").agg(F.min("at").alias("low")))  # of equal fingerprints only the first can stay
    winners = fingerprint_components(distinct, max_bits).select(F.col("component_id").alias("at")).distinct()
    kept = rows.select("at", "key", "row").join(winners, "at", "left_semi")
    nth = F.row_number().over(Window.partitionBy("at").orderBy("key"))
    return kept.withColumn("nth", nth).where("nth = 1").select("row.*")
