"""Language identification with error-correcting output codes.

Each learned language has a codeword; each bit of it has a binary classifier over hashed byte 2- to 4-grams (log odds of
a naive Bayes model of the languages whose bit is 1 against the others). A text's bits are decoded to the codeword of
least loss, each bit weighed by how well its classifier tells the training languages apart; a text whose two least
losses are close is flagged as ambiguous.

Training reads at most about ``sample`` labelled texts a language, drawn by a hash of their id (a bound, not a share of
the data); the counts are summed on the executors, and languages times buckets go to the driver.

Defined results: ``und`` with score 0 for null text or text without a letter; with no labelled row at all every text is
``und``. Rows keep their doc_id, null or repeated; a null label teaches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
#: Letters in lower case, bytes of other scripts as they are, everything else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPACES = re.compile(rb" +")
MIXERS = {2: (1, 263), 3: (1, 263, 69_169), 4: (1, 263, 69_169, 18_191_447)}


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's grams, a block at a time."""
    raw = np.frombuffer(SPACES.sub(b" ", b" " + text.lower().encode().translate(FOLD) + b" "), np.uint8).astype(np.uint32)
    for at in range(0, len(raw), 1 << 16):
        here = raw[at : at + (1 << 16) + 3]
        for n in GRAMS:
            size = min(1 << 16, len(here) - n + 1)
            if size > 0:
                h = np.full(size, n * 40_503, np.uint32)
                for i, m in enumerate(MIXERS[n]):
                    h += here[i : i + size] * np.uint32(m)
                h *= np.uint32(2_654_435_761)
                yield (h >> np.uint32(17)).astype(np.int32)


def codewords(n: int) -> np.ndarray:
    """A row of bits for each of ``n`` classes: the exhaustive code up to 6 classes, a seeded random one beyond."""
    if n <= 2:
        return np.eye(max(n, 1), dtype=bool)
    if n <= 6:
        columns = np.arange(1, 1 << (n - 1))
        return np.array([[bool((c << 1 | 1) >> i & 1) for c in columns if (c << 1 | 1) != (1 << n) - 1] for i in range(n)])
    rng, best, apart = np.random.default_rng(11), None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (n, int(10 * np.ceil(np.log2(n)))), dtype=np.uint8).astype(bool)
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if least > apart:
            best, apart = code, least
    return best


class CodeModel:
    """Weights (bucket by bit), bit weights and codewords of the learned languages."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.3):
        self.langs = langs
        if not langs:
            return
        self.code = codewords(len(langs))
        rate = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * BUCKETS)  # each language counts alike
        columns = []
        for bit in self.code.T:
            one = rate[bit].mean(0) if bit.any() else np.full(BUCKETS, 1 / BUCKETS)
            zero = rate[~bit].mean(0) if (~bit).any() else np.full(BUCKETS, 1 / BUCKETS)
            columns.append(np.log(one) - np.log(zero))
        self.weights = np.array(columns, np.float32).T.copy()
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        margin = share @ self.weights * np.where(self.code, 1, -1)  # a language's mean margin at each bit
        self.bit_weight = np.clip(margin.min(0), 0.01, None) if margin.size else np.ones(self.code.shape[1])
        self.bit_weight = self.bit_weight / self.bit_weight.mean()
        self.scale = np.maximum(np.abs(margin).mean(0), 1e-6)

    def losses(self, text: str) -> np.ndarray:
        """Of each codeword: weighted logistic loss of the bits' margins."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for h in grams(text):
            total += self.weights[h].sum(0, dtype=np.float64)
            n += len(h)
        margin = total / max(n, 1) / self.scale * min(6.0, 0.3 * np.sqrt(max(n, 1)))  # short texts say less
        signs = np.where(self.code, 1, -1)
        return (self.bit_weight * np.logaddexp(0, -signs * margin)).sum(1)

    def predict(self, text: str | None, margin: float = 0.1) -> tuple[str, float, bool]:
        """(language, score, ambiguous)"""
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0, False
        loss = self.losses(text)
        odds = np.exp(loss.min() - loss)
        odds /= odds.sum()
        order = np.argsort(-odds, kind="stable")
        return self.langs[order[0]], float(odds[order[0]]), bool(len(order) > 1 and odds[order[0]] - odds[order[1]] < margin)


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000) -> CodeModel:
    """Learn from rows with a label and a text; about ``sample`` texts a language."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return CodeModel([], np.zeros((0, BUCKETS)))
    langs = sorted(sizes)
    rates = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    draw = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                if LETTER.search(text.as_py()):
                    mine = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for h in grams(text.as_py()):
                        mine += np.bincount(h, minlength=BUCKETS)
        for lang, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["lang", "bucket", "n"])

    chosen = rows.where(draw < rates[F.col("lang")]).select("text", "lang")
    found = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(langs, found["lang"].to_numpy().astype(str)), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return CodeModel(langs, counts)


def identify(df: DataFrame, model: CodeModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), keep_text: bool = False, margin: float = 0.1) -> DataFrame:
    """One row per row: doc_id, the ``keep`` columns, lang_pred, score, ambiguous (and ``text``). One pass, no exchange."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages times buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [m.predict(t.as_py(), margin) for t in b.column(0)]
            cols = list(zip(*out)) or [()] * 3
            held = b.columns[0 if keep_text else 1 :]
            yield pa.RecordBatch.from_arrays([*held, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=[*inner_names, "lang_pred", "score", "ambiguous"])

    inner = df.select(F.col(text_col).alias("__text"), F.col(id_col).alias("doc_id"), *keep)
    fields = inner.schema.fields[0 if keep_text else 1 :]
    inner_names = ["text" if f.name == "__text" else f.name for f in fields]
    kinds = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(inner_names, fields))
    return inner.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
