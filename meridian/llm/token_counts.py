"""Whole-token shortcut for counting subword tokens.

Offline, from the vocabulary alone: (1) no piece has the word mark after another character, so merges never cross from
a word into the next mark; (2) a line feed is in no piece, so it is one byte token and merges never cross it; (3) no piece
has a letter before certain stops, so those part from their word; (4) a piece that encodes alone to itself counts one wherever it is a whole pre-token. Texts are then cut into pre-tokens,
those in the table count at once, and only the rest goes through the merges, each distinct one once in a while.

Defined results: null text counts as empty; an empty text has 0 tokens. Rows keep their doc_id, null or repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARK = "▁"
RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class WholeTokenCounter:
    """Counts of one model; ``keep`` bounds the table of merged pre-tokens."""

    def __init__(self, model_path: str, keep: int = 400_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.keep = keep
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain) and not any("\n" in p for p in plain)
        self.splits = self.splits and self.sp.encode("\n", out_type=str) == [MARK, "<0x0A>"]
        joined = {c for p in plain for x, c in zip(p, p[1:]) if x.isalpha()}
        self.tails = "".join(c for c in ",.;:!?" if c not in joined)
        self.whole = self.prove(plain)
        self.marked = {w: 1 for w in self.whole}
        self.bare: dict[str, int] = {}

    def prove(self, plain: list[str]) -> list[str]:
        """Vocabulary words, without their mark, that encode alone as one token."""
        words = [p[1:] for p in plain if p[:1] == MARK and len(p) > 1 and MARK not in p[1:]]
        return [w for w, ids in zip(words, self.sp.encode(words, num_threads=1)) if len(ids) == 1]

    def _marked(self, word: str) -> int:
        """Tokens of the mark followed by ``word`` (which may start with more marks)."""
        n = self.marked.get(word)
        if n is None:
            if len(self.marked) > self.keep:
                self.marked = {w: 1 for w in self.whole}
            stem = word.rstrip(self.tails)
            if stem and stem != word and stem[-1].isalpha():
                n = self._marked(stem) + self._bare(word[len(stem) :])
            else:
                n = len(self.sp.encode(word.replace(MARK, " "))) if word else 1
            self.marked[word] = n
        return n

    def _bare(self, word: str) -> int:
        """Tokens of ``word`` without a mark before it: behind a line feed, which nothing merges with."""
        n = self.bare.get(word)
        if n is None:
            if len(self.bare) > self.keep:
                self.bare = {}
            n = self.bare[word] = len(self.sp.encode("\n" + word)) - 2
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.sp.encode(text))
        lines = f" {text}".split("\n")
        total, get = len(lines) - 1, self.marked.get
        for line in lines:
            if not line:
                continue
            if "  " in line or MARK in line or line[-1] == " ":
                for run in RUN.findall(line.replace(" ", MARK)):
                    total += self._marked(run[1:]) if run[0] == MARK else self._bare(run)
                continue
            head, *words = line.split(" ")
            if head:
                total += self._bare(head)
            counts = list(map(get, words))
            if None in counts:
                counts = [self._marked(w) if n is None else n for w, n in zip(words, counts)]
            total += sum(counts)
        return total


@cache
def token_counter(model_path: str, keep: int) -> WholeTokenCounter:
    """One a process, so that tasks go on with the table of those before."""
    return WholeTokenCounter(model_path, keep)


def count_tokens(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, keep: int = 400_000) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit. One pass over the texts, no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(model_path, keep)
        for b in batches:
            n = pa.array([counter.count(t.as_py()) for t in b.column(1)], pa.int64())
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
