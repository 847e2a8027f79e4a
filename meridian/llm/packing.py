"""Packing token sequences with the configuration linear program over the length histogram.

Tokenised texts are cut into pieces of at most ``capacity`` tokens; only the histogram of piece lengths (one count a
length) goes to the driver. The configuration program, least total weight of configurations (multisets of lengths that
fit) that covers every length's count, is solved by multiplicative weights in whole uses: each round a knapsack program
over capacities prices configurations under the lengths' weights, the priced one with each length is used to a step, and
what is covered loses weight. Rounds go on until all pieces are covered, however many rows there are; how many rounds and
configurations that takes depends on the lengths. Best fit on the histogram, alike sequences as one, is the yardstick: its
plan is taken only where it saves over a thousandth of the sequences. Pieces get ranks within their length (counted in
salted parts, so one frequent length is spread) and take the slots of their rank.

Defined results: null text counts as empty and packs as its end token; equal rows are packed each; an empty table packs
into nothing; a document longer than the capacity, and only such, is cut.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts

#: Fixed value: the pre-tokeniser's pattern, as in the vocabulary file.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Separators that the tokeniser drops but str.split does not know as such, and the other way round.
ODD = re.compile("[\x1c-\x1f]")
NARROW = re.compile("[\x00-\xff]*")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(256 + n) for n, b in enumerate(other)}


class Recent(dict):
    """A table of bounded size: when full, the entries move aside for as long as it takes to fill it again."""

    def __init__(self, keep: int):
        super().__init__()
        self.keep, self.aside = keep, {}

    def find(self, key):
        """The value or None; what is found aside comes back."""
        value = self.get(key)
        if value is None and (value := self.aside.get(key)) is not None:
            self[key] = value
        return value

    def room(self, n: int) -> None:
        if len(self) + n > self.keep:
            self.aside = dict(self)
            self.clear()


class WordEncoder:
    """Ids of whole texts by words: words that came before are looked up, only new ones go through the merges.

    White space ends words and is dropped, so words encode alone as they do in a text. A narrow word (up to U+00FF, no
    special string) is cut into pre-tokens, whose bytes go to the model's merges; any other word to the whole tokeniser.
    """

    def __init__(self, path: str, keep: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cut = regex.compile(PRETOKEN).findall
        self.letters = byte_letters()
        self.words, self.tokens = Recent(keep), Recent(keep)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _token(self, t: str) -> bytes:
        raw = self.tokens.find(t)
        if raw is None:
            self.tokens.room(1)
            raw = self.tokens[t] = array("I", [x.id for x in self.merge(t.encode().decode("latin-1").translate(self.letters))]).tobytes()
        return raw

    def _word(self, w: str) -> bytes:
        if w.isascii():
            if w.isalpha():
                return self._token(w.lower())
            if w[:-1].isalpha() and w[-1] in ",.;:!?":
                return self._token(w[:-1].lower()) + self._token(w[-1])
        if not NARROW.fullmatch(w) or any(s in w for s in self.special):
            return self._plain(w)
        return b"".join(map(self._token, self.cut(unicodedata.normalize("NFC", w).lower())))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        find, words = self.words.get, self.words
        for text in texts:
            parts_: list[bytes] = []
            if not text or ODD.search(text):
                yield self._plain(text) if text else b""
                continue
            split = text.split()
            for at in range(0, len(split), 4096):
                some = split[at : at + 4096]
                words.room(4096)
                out = list(map(find, some))
                if None in out:
                    for i, raw in enumerate(out):
                        if raw is None:
                            w = some[i]
                            raw = words.find(w)
                            if raw is None:
                                raw = words[w] = self._word(w)
                            out[i] = raw
                parts_ += out
            yield b"".join(parts_)


@cache
def word_encoder(path: str) -> WordEncoder:
    """One a process, so that tasks go on with the table of those before."""
    return WordEncoder(path)


def pieces(df: DataFrame, tokenizer: str, *, id_col: str, text_col: str, capacity: int, end: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); one pass, no exchange."""
    tail = np.uint32(end).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            ids = encoder.encode(b.column(1).to_pylist())
            for doc, raw in zip(b.column(0).to_pylist(), ids):
                raw += tail
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> list[int]:
    """Knapsack by dynamic programming: the last length of the greatest value in each room (-1: as in one room less)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for room in range(int(lengths[0]), capacity + 1):
        k = np.searchsorted(lengths, room, "right")
        gain = best[room - lengths[:k]] + value[:k]
        top = int(gain.argmax())
        if gain[top] > best[room - 1]:
            best[room], choice[room] = gain[top], top
        else:
            best[room] = best[room - 1]
    return choice.tolist()


def configuration(first: int, lengths: list[int], choice: list[int], ends: list[int], left: list[int], below: list[int], capacity: int) -> tuple[dict[int, int], int]:
    """The priced configuration with the length at ``first`` in it, and its room; where pieces lack, the longest there are."""
    uses, space, room = {first: 1}, capacity - lengths[first], capacity - lengths[first]
    while (room := ends[room]) > 0:
        i = choice[room]
        if uses.get(i, 0) < left[i]:
            uses[i] = uses.get(i, 0) + 1
            space -= lengths[i]
        room -= lengths[i]
    i = len(lengths)
    while (i := min(i, bisect_right(lengths, space)) - 1) >= 0:
        at = i
        while i >= 0 and not left[i]:
            i = below[i]
        below[at] = i if at != i else at - 1
        if i >= 0 and (n := min(left[i] - uses.get(i, 0), space // lengths[i])) > 0:
            uses[i] = uses.get(i, 0) + n
            space -= n * lengths[i]
    return uses, space


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 60, epsilon: float = 0.15, spare: int = 0, slack: float = 1 / 2048) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Multiplicative weights for the covering program in whole uses: [(configuration, times)], and the counts left over.

    Rounds go on until the program is covered, all but ``spare`` pieces of each length. A round prices configurations
    once and uses the best one with each length, longest first, where it is full enough, to a step. A round that covers
    less than one part in ``rounds`` of all tokens widens what is full enough, so rounds end soon: how many they are, and
    how many configurations, depends on the lengths and the parameters, not on the counts.
    """
    free, found = np.maximum(counts - spare, 0), Counter()
    step = np.maximum(1, counts * epsilon / 2).astype(np.int64)
    total = max(1, int((lengths * counts).sum()) // capacity // rounds)
    while (free > 0).any():
        before = int((lengths * free).sum())
        here = np.flatnonzero(free)
        left, sizes, most = free[here].tolist(), lengths[here].tolist(), step[here].tolist()
        covered = 1 - free[here] / counts[here]
        choice = price(lengths[here], lengths[here] * np.exp(-(covered - covered.min()) / epsilon), capacity)
        ends, end = [], 0
        for room, i in enumerate(choice):
            end = room if i >= 0 else end
            ends.append(end)
        below = list(range(-1, len(sizes) - 1))
        for first in range(len(sizes) - 1, -1, -1):
            if not left[first]:
                continue
            uses, space = configuration(first, sizes, choice, ends, left, below, capacity)
            if space > slack * capacity:
                continue
            times = max(1, min(total, most[first] // uses[first], *(left[i] // n for i, n in uses.items())))
            for i, n in uses.items():
                left[i] -= n * times
            found[tuple(sorted((sizes[i], n) for i, n in uses.items()))] += times
        free[here] = left
        if before - int((lengths * free).sum()) < total * capacity:
            slack *= 4
    plan, rest = [(dict(config), times) for config, times in found.items()], counts.copy()
    for config, times in plan:
        for n, each in config.items():
            rest[np.searchsorted(lengths, n)] -= each * times
    return plan, rest


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, plan: list[tuple[dict[int, int], int]]) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, by remaining room into the bins of ``plan`` and new ones; equal bins are filled as one."""
    by_room: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, bool)

    def put(config: dict[int, int], times: int, room: int) -> None:
        if times:
            by_room[room].append((config, times))
            rooms[room] = True

    for config, times in plan:
        put(config, times, capacity - sum(n * each for n, each in config.items()))
    for size, n in zip(lengths[::-1].tolist(), counts[::-1].tolist()):
        while n:
            fits = rooms[size:]
            room = int(fits.argmax()) + size
            if fits.any():
                config, times = by_room[room].pop()
                rooms[room] = bool(by_room[room])
            else:
                config, times, room = {}, n, capacity
            each = min(n, room // size)
            some = min(times, n // each)  # one after the other, these bins take as many as they have room for
            if config:
                put(config, times - some, room)
            put(config | {size: config.get(size, 0) + each}, some, room - each * size)
            n -= some * each
    return [group for groups in by_room for group in groups]


def plan_bins(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """[(configuration, times)], and the number of bins: the program's solution, which places all pieces unless some are spared.

    Best fit alone is taken where it saves more than one bin in a thousand (a length that fills the table can leave the
    program's last ones poor).
    """
    if not len(lengths):
        return [], 0
    plan, rest = solve_configurations(lengths, counts, capacity)
    (plan, bins), (alone, least) = ((p, sum(t for _, t in p)) for p in (best_fit(lengths, rest, capacity, plan), best_fit(lengths, counts, capacity, [])))
    return (plan, bins) if bins <= 1.001 * least else (alone, least)


def slot_table(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """Slots by length: ranks from ``first`` on lie in bins from ``bin`` on, ``each`` a bin, at ``offset`` onwards."""
    used, bin_at, rows = {}, 0, []
    for config, times in plan:
        offset = 0
        for n, each in sorted(config.items(), reverse=True):
            rows.append((n, used.get(n, 0), bin_at, each, offset))
            used[n] = used.get(n, 0) + each * times
            offset += n * each
        bin_at += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "bin", "each", "offset"), table.T))


def pack(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    cuts = cut(pieces(df, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end=end))
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts(spark))).cast("int"))
    counts = cut(salted.groupBy("length", "salt").count())
    histogram = counts.groupBy("length").agg(F.sum("count").alias("n")).orderBy("length").collect()  # at most ``capacity`` rows
    lengths = np.array([r["length"] for r in histogram], np.int64)
    plan, _ = plan_bins(lengths, np.array([r["n"] for r in histogram], np.int64), capacity)
    slots = spark.sparkContext.broadcast(slot_table(plan, capacity))  # rows by configurations and lengths, not by data

    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "salt", before.alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.join(starts, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", rank.alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = slots.value
        scale = np.int64(1) << 44
        keys = t["length"] * scale + t["first"]
        for b in batches:
            n, r = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, n * scale + r, "right") - 1
            inside = r - t["first"][at]
            seq = t["bin"][at] + inside // t["each"][at]
            offset = t["offset"][at] + inside % t["each"][at] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cuts.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
