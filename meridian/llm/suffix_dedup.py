"""Removal of repeated long passages with a logarithmic family of (sparse) suffix arrays.

A rule names the passages to go: ``length`` bytes or more that start elsewhere too. Every window of the shortest rule's
length is represented by one suffix: the one that starts at the window's anchor, the leftmost position of least rolling
hash among its ``gram``-byte grams. Equal windows have equal anchors, so windows can only be equal where anchors have
equal grams, and a suffix array over anchors finds every long match (bidirectional string anchors). About 2 in
``length - gram`` positions are anchors. A longer rule's window is looked for at the anchor of its first short window.

1. Distinct texts are written once, bucketed by their digest (120 bits); no later join moves a text.
2. Each text gives its anchors: gram hash, hash of the whole context (all windows of the anchor; with the gram hash 128
   bits), text key, first and last position of a run of equal ones (periodic text is one run, not an anchor a period).
   Grams seen once are done with.
3. Contexts that occur twice are settled by that count. Grams with several contexts go on, one representative text slice
   a context, dealt by gram. A task feeds them batch by batch to a ``SuffixArrayFamily``: each batch gets its suffix array
   (and the order of its reversed left contexts), is merge-scanned against the levels for windows that both hold, and
   levels of a size merge.
4. A gram of more than ``most`` contexts is not held in one task: its windows are counted by their hashes, all partial
   aggregates, after eight wider strings a context have told which windows can be repeated at all.
5. Windows found go back to their anchors and texts, are joined into runs and cut out.

Joins on a gram or a context send the keys that hold over a thousandth of the rows (so fewer than 1,000) as a broadcast;
the rest is dealt by key.

Defined results: null text counts as empty; texts shorter than a rule's length keep everything; whole-text copies of that
length or more lose everything, each copy, whatever the rule's ``words``; rows keep their doc_id, null or repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, counted, heavy_join, scratch

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
STEP = 1 << 19
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
KEY = ["tk", "tl"]
#: Strings a context of a frequent gram is first counted by.
RANGES = 8


@dataclass(frozen=True)
class Rule:
    """Runs of bytes in strings of ``length`` that start elsewhere too; with ``across``, in another text; runs of fewer than ``words`` words stay."""

    length: int = 400
    words: int = 0
    across: bool = False


#: What the pipeline cuts: passages of over 50 words that another document holds as well (51 words of 200 bytes or more).
PASSAGES = Rule(200, 51, True)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the multiplier and of its inverse, modulo 2^64."""

    def of(x: int) -> np.ndarray:
        factors = np.full(n + 1, x, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    return of(MULTIPLIER), of(pow(MULTIPLIER, -1, 1 << 64))


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbouring keys, by prefix and suffix minima of blocks."""
    n = len(keys)
    m = n - w + 1
    if m <= 0:
        return keys[:0]
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


VALUES = np.random.default_rng(7).integers(1, np.iinfo(np.uint64).max, 256, dtype=np.uint64)


class Anchors:
    """Anchor positions of texts that lie one after another in a buffer."""

    def __init__(self, length: int = 400, gram: int = 64, far: int = 400):
        self.length, self.gram, self.far, self.spread = length, gram, far, length - gram
        self.up, self.down = _powers(STEP + 3 * length + far)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, gram hashes, context hashes); windows and contexts never cross the texts' bounds."""
        at, grams, contexts, low = [], [], [], np.uint64((1 << 20) - 1)
        last_start = np.zeros(len(data) + 1, np.int32)  # +1 where windows become valid, -1 behind the last valid one
        long = ends - starts >= self.length
        np.add.at(last_start, starts[long], 1)
        np.add.at(last_start, ends[long] - self.length + 1, -1)
        valid = np.cumsum(last_start)[:-1] > 0
        k = self.gram
        for begin in range(0, len(data) - self.length + 1, STEP):
            n = min(STEP, len(data) - self.length + 1 - begin)  # windows that start here
            ok = valid[begin : begin + n]
            if not ok.any():
                continue
            base = max(0, begin - self.spread)
            here = data[base : begin + n + self.spread + self.far]
            with np.errstate(over="ignore"):
                sums = np.empty(len(here) + 1, np.uint64)
                sums[0] = 0
                np.cumsum(VALUES[here] * self.up[: len(here)], out=sums[1:], dtype=np.uint64)
                skip, m = begin - base, n + self.spread
                h = _mixed((sums[skip + k : skip + m + k] - sums[skip : skip + m]) * self.down[skip : skip + m])
                least = sliding_min((h & ~low) | np.arange(m, dtype=np.uint64), self.spread + 1)[:n]
                found = np.unique((least[ok] & low).astype(np.int64))
                doc = np.searchsorted(starts, found + begin, "right") - 1
                s = np.maximum(starts[doc], found + begin - self.spread) - base
                e = np.minimum(ends[doc], found + begin + self.far) - base
                shape = (found + skip - s).astype(np.uint64) << np.uint64(32) | (e - s).astype(np.uint64)
                contexts.append(_mixed(_mixed((sums[e] - sums[s]) * self.down[s]) + shape * np.uint64(MULTIPLIER)))
            at.append(found + begin)
            grams.append(h[found])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at, first = np.unique(np.concatenate(at), return_index=True)
        return at, np.concatenate(grams)[first], np.concatenate(contexts)[first]


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a string or binary column (null: empty)."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def pages(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text (a longer text is a slice of its own)."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        for page in np.unique(np.cumsum(sizes) // most, return_counts=True)[1].tolist():
            yield b.slice(at, page)
            at += page


def aligned(left: np.ndarray, bodies: pa.Array, spread: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Slices as rows with the anchor at column ``spread``, zeros around; and the bytes from the anchor on."""
    data, starts, ends = _buffer(bodies)
    columns, first = np.arange(spread + far)[None, :], (spread - left)[:, None]
    out = np.zeros((len(left), spread + far), np.uint8)
    out[(columns >= first) & (columns < first + (ends - starts)[:, None])] = data
    return out, ends - starts - left


def _keys(group: np.ndarray, strings: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte strings that sort by group, string, size (a string before its continuation with zero bytes)."""
    out = np.concatenate((group.astype(">i8").view(np.uint8).reshape(-1, 8), strings, sizes.astype(">u2").view(np.uint8).reshape(-1, 2)), 1)
    return np.ascontiguousarray(out).view(f"S{out.shape[1]}").ravel()


class SuffixArrayFamily:
    """Levels of suffix arrays over anchored slices; each pair of slices of a group is compared once.

    ``add`` takes a batch: groups, least and greatest key of the texts that hold a slice, bytes left of the anchors,
    slices. ``windows(rule)`` tells for each slice, in the order added, which left lengths x begin a window of x bytes left
    and ``length - x`` bytes right of the anchor that another slice of the group has as well.
    """

    def __init__(self, rules: tuple[Rule, ...] = (Rule(),), spread: int = 336):
        self.rules, self.spread, self.far = rules, spread, max(r.length for r in rules)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted keys, slice numbers
        self.rows = np.zeros((0, spread + self.far), np.uint8)
        self.group = self.low = self.high = self.left = self.right = np.zeros(0, np.int64)
        self.edges = [np.zeros((0, spread + 2), np.int32) for _ in rules]  # where runs of windows begin (+) and end (-)

    def add(self, group: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, bodies: pa.Array) -> None:
        base, n = len(self.group), len(group)
        rows, right = aligned(left, bodies, self.spread, self.far)
        self.rows = np.concatenate((self.rows, rows))
        self.group, self.low, self.high = np.append(self.group, group), np.append(self.low, low), np.append(self.high, high)
        self.left, self.right = np.append(self.left, left), np.append(self.right, right)
        self.edges = [np.concatenate((e, np.zeros((n, self.spread + 2), np.int32))) for e in self.edges]
        keys = _keys(group, rows[:, self.spread :], right)
        order = np.argsort(keys, kind="stable")
        batch = keys[order], base + order
        self._scan(batch[1])
        for level in self.levels:
            shared = np.isin(self.group[level[1]], group)
            if shared.any():
                own = np.isin(self.group[batch[1]], self.group[level[1][shared]])
                self._scan(self._merged((level[0][shared], level[1][shared]), (batch[0][own], batch[1][own]))[1])
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2][1]) < 2 * len(self.levels[-1][1]):
            top = self.levels.pop()
            self.levels[-1] = self._merged(self.levels[-1], top)

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """One sorted run of two."""
        at = np.searchsorted(a[0], b[0], "right")
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])

    def _common(self, order: np.ndarray, columns: slice, sizes: np.ndarray) -> np.ndarray:
        """Bytes each slice shares with the one before it in ``order``; -1 at a new group."""
        out = np.full(len(order), -1, np.int64)
        for at in range(1, len(order), 4096):
            b = order[at : at + 4096]
            a = order[at - 1 : at - 1 + len(b)]
            differ = self.rows[a][:, columns] != self.rows[b][:, columns]
            shared = np.where(differ.any(1), differ.argmax(1), differ.shape[1])
            out[at : at + len(b)] = np.where(self.group[a] == self.group[b], np.minimum(shared, np.minimum(sizes[a], sizes[b])), -1)
        return out

    def _scan(self, order: np.ndarray) -> None:
        """Mark the windows that two slices of ``order`` (in suffix order) share."""
        if len(order) < 2:
            return
        back = slice(self.spread - 1, None, -1) if self.spread else slice(0, 0)
        backs = self.rows[order][:, : self.spread][:, ::-1]
        by_left = order[np.argsort(_keys(self.group[order], backs, self.left[order]), kind="stable")]
        rights = self._common(order, slice(self.spread, None), self.right)
        lefts = self._common(by_left, back, self.left)
        place = np.empty(int(order.max()) + 1, np.int64)  # of a slice in left order
        place[by_left] = np.arange(len(order))
        to_left = place[order]
        start = np.flatnonzero(rights < 0)
        size = np.diff(np.append(start, len(order)))
        which = np.repeat(np.arange(len(start)), size)
        for rule, edges in zip(self.rules, self.edges):
            self._mark(rule, edges, order, rights, lefts, to_left, start, size, which)

    def _mark(self, rule: Rule, edges: np.ndarray, order, rights, lefts, to_left, start, size, which) -> None:
        """Classes of equal windows change only where x passes a shared length of two neighbours or the end of a slice."""
        n, length = len(order), rule.length
        best = np.maximum(rights, np.append(rights[1:], -1))
        near = np.maximum(lefts, np.append(lefts[1:], -1))[to_left]
        group_ok = np.zeros(len(start), bool)
        group_ok[which[(best >= 0) & (length - best <= near)]] = True
        if not group_ok.any():
            return
        x = np.concatenate((np.zeros(n, np.int64), length - rights, lefts + 1, length - self.right[order], self.left[order] + 1))
        g = np.tile(which, 5)
        event = np.unique((g * np.int64(self.spread + 1) + x)[(x >= 0) & (x <= self.spread) & group_ok[g]])
        g, x = event // (self.spread + 1), event % (self.spread + 1)
        until = np.where(np.append(g[1:] == g[:-1], False), np.append(x[1:], 0), self.spread + 1)
        ends = np.cumsum(size[g])
        at = 0
        while at < len(g):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
            self._classes(rule, edges, order, rights, lefts, to_left, start[g[at:to]], size[g[at:to]], x[at:to], until[at:to])
            at = to

    def _classes(self, rule: Rule, edges, order, rights, lefts, to_left, start, size, x, until) -> None:
        base = np.cumsum(size) - size
        event = np.repeat(np.arange(len(x)), size)
        inside = np.arange(len(event)) - base[event]
        at, xs = start[event] + inside, x[event]
        by_right = np.cumsum(rights[at] < rule.length - xs)
        by_left = np.cumsum(lefts[at] < xs)[base[event] + to_left[at] - start[event]]
        slices = order[at]
        ok = np.flatnonzero((self.right[slices] >= rule.length - xs) & (self.left[slices] >= xs))
        if len(ok) < 2:
            return
        pair = by_right[ok].astype(np.int64) << 32 | by_left[ok]
        rank = np.argsort(pair, kind="stable")
        ok, pair = ok[rank], pair[rank]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        if rule.across:
            repeated = np.minimum.reduceat(self.low[slices[ok]], first) < np.maximum.reduceat(self.high[slices[ok]], first)
        else:
            repeated = np.diff(np.append(first, len(ok))) > 1
        hit = ok[np.repeat(repeated, np.diff(np.append(first, len(ok))))]
        np.add.at(edges, (slices[hit], xs[hit]), 1)
        np.add.at(edges, (slices[hit], until[event[hit]]), -1)

    def windows(self, rule: int = 0) -> np.ndarray:
        return np.cumsum(self.edges[rule], axis=1)[:, :-1] > 0


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs (touching ones join)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]


def window_hashes(rows: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the strings that begin in the columns ``first``, for each row."""
    up, down = _powers(rows.shape[1] + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum(VALUES[rows] * up[: rows.shape[1]], axis=1, out=sums[:, 1:], dtype=np.uint64)
        return _mixed((sums[:, first + size] - sums[:, first]) * down[first])


def _new(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """Rows of texts not seen yet in this task."""
    keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    return batch.filter(pa.array([k not in seen and not seen.add(k) for k in keys], pa.bool_()))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for b in batches:
        yield _new(b, seen)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def around(batches: Iterator[pa.RecordBatch], spread: int, far: int) -> Iterator[pa.RecordBatch]:
    """(tk, tl, text, wanted) -> a row for each context wanted, with the slice around its anchor; 1024 rows are held at once."""
    for b in pages(batches, 2):
        data, starts, ends = _buffer(b.column(2))
        every = pa.RecordBatch.from_struct_array(b.column(3).flatten())
        doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False))
        for n in range(0, len(doc), 1024):
            w, d = every.slice(n, 1024), doc[n : n + 1024]
            at = w.column("pos").to_numpy().astype(np.int64)
            left = np.minimum(at, spread)
            begin = starts[d] + at - left
            size = np.minimum(starts[d] + at + far, ends[d]) - begin
            offsets = np.append(0, np.cumsum(size))
            bytes_ = data[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
            body = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(bytes_)])
            yield pa.RecordBatch.from_arrays([*(w.column(c) for c in ("gram", "ctx", "t0", "t1", "hot")), pa.array(left.astype(np.int32)), body], names=["gram", "ctx", "t0", "t1", "hot", "lhs", "body"])


def anchors_of(texts: DataFrame, rules: tuple[Rule, ...], *, gram: int = 64) -> DataFrame:
    """(gram, ctx, tk, tl, pos, last): the anchors of (tk, tl, text), a run of equal ones as one row."""
    short, far = min(r.length for r in rules), max(r.length for r in rules)
    spread = short - gram

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(short, gram, far)
        for b in pages(batches, 2):
            data, starts, ends = _buffer(b.column(2))
            at, grams, contexts = find.find(data, starts, ends)
            doc = np.searchsorted(starts, at, "right") - 1
            new = np.ones(len(at), bool)  # equal neighbours are one run: their gap is less than a window
            new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1]) | (contexts[1:] != contexts[:-1]) | (at[1:] - at[:-1] > spread)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at))[: len(first)] - 1
            key = doc[first]
            columns = [grams[first].view(np.int64), contexts[first].view(np.int64), *(b.column(i).to_numpy(zero_copy_only=False)[key] for i in (0, 1)), (at[first] - starts[key]).astype(np.int32), (at[last] - starts[key]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "ctx", "tk", "tl", "pos", "last"])

    return scratch(texts.mapInArrow(anchored, "gram long, ctx long, tk long, tl long, pos int, last int").sortWithinPartitions("gram"), "anchors")


def repeated_windows(texts: DataFrame, anchors: DataFrame, rules: tuple[Rule, ...], *, gram: int = 64, most: int = 20_000) -> DataFrame:
    """(tk, tl, spans) for distinct ``texts`` (tk, tl, text) and their anchors: those with what is repeated around them."""
    short, far = min(r.length for r in rules), max(r.length for r in rules)
    spread = short - gram
    times = F.sum(F.when(F.col("last") > F.col("pos"), 2).otherwise(1))
    grams = scratch(anchors.groupBy("gram").agg(times.alias("n")).where("n > 1"), "grams")
    again, n_again = counted(heavy_join(anchors, grams, ["gram"], "n", anchors.count()).drop("n"), "repeated")
    contexts, n_contexts = counted(again.groupBy("gram", "ctx").agg(times.alias("n"), F.count("*").alias("rows"), F.min("tk").alias("t0"), F.max("tk").alias("t1"), F.min(F.struct(*KEY, "pos")).alias("rep")).select("gram", "ctx", "n", "rows", "t0", "t1", "rep.*"), "contexts")
    several = scratch(contexts.groupBy("gram").agg(F.count("*").alias("several")).where("several > 1"), "several")
    apart = heavy_join(contexts, several, ["gram"], "several", n_contexts)

    # one slice for each context that must be compared
    wanted = apart.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "ctx", "pos", "t0", "t1", (F.col("several") > most).alias("hot"))).alias("wanted"))

    slices = texts.join(wanted, KEY).select(*KEY, "text", "wanted").mapInArrow(lambda batches: around(batches, spread, far), "gram long, ctx long, t0 long, t1 long, hot boolean, lhs int, body binary")
    n_apart, n_hot = several.agg(F.coalesce(F.sum("several"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("several") > most, F.col("several"))), F.lit(0))).first()
    if n_hot:  # read several times; otherwise slices go to their tasks as they are cut
        slices = scratch(slices, "slices")
    cold = slices.where("not hot")
    shards = max(1, -(-(n_apart - n_hot) // most)) * 4

    def compared(table: pa.Table) -> pa.Table:
        family, keys = SuffixArrayFamily(rules, spread), []
        for b in table.combine_chunks().to_batches(max_chunksize=1024):
            c = {name: b.column(n) for n, name in enumerate(b.schema.names)}
            keys.append((c["gram"].to_numpy(), c["ctx"].to_numpy()))
            family.add(c["gram"].to_numpy(), c["t0"].to_numpy(), c["t1"].to_numpy(), c["lhs"].to_numpy().astype(np.int64), c["body"])
        grams, contexts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*keys)) or [(), ()]))
        out = []
        for k, rule in enumerate(rules):
            hit = np.pad(family.windows(k), ((0, 0), (1, 1))).astype(np.int8)
            (row, x0), x1 = np.nonzero(np.diff(hit, axis=1) == 1), np.nonzero(np.diff(hit, axis=1) == -1)[1]
            out.append((grams[row], contexts[row], np.full(len(row), k), 1 - x1, rule.length - x0))
        return pa.table([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*out), (np.int64, np.int64, np.int32, np.int32, np.int32))], names=["gram", "ctx", "rule", "lo", "hi"])

    kind = "gram long, ctx long, rule int, lo int, hi int"
    found = cold.withColumn("cell", F.pmod("gram", F.lit(shards))).groupBy("cell").applyInArrow(lambda t: compared(t.drop_columns(["cell", "hot"])), kind)
    if n_hot:
        found = found.unionByName(_counted(slices.where("hot"), rules, spread, n_hot).select("gram", "ctx", "rule", "lo", "hi"))
    found = found.groupBy("gram", "ctx").agg(F.collect_set(F.struct("rule", "lo", "hi")).alias("found"))
    settled = contexts.select("gram", "ctx", "rows", (F.col("n") > 1).alias("twice"), (F.col("t0") < F.col("t1")).alias("across")).join(found, ["gram", "ctx"], "left").where("twice or found is not null")
    settled = scratch(settled, "settled")
    return heavy_join(again, settled, ["gram", "ctx"], "rows", n_again).groupBy(*KEY).agg(F.collect_list(F.struct("pos", "last", "twice", "across", "found")).alias("spans"))


def _counted(slices: DataFrame, rules: tuple[Rule, ...], spread: int, n: int) -> DataFrame:
    """What ``compared`` finds, for grams of any number of contexts: equal windows by their hashes, no group in a task."""
    short, far = min(r.length for r in rules), max(r.length for r in rules)
    bounds = np.unique(np.linspace(0, spread + 1, RANGES + 1).astype(np.int64))
    low, high = bounds[:-1], bounds[1:] - 1  # left lengths of each range; its windows share what lies within all

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(at, 512) for part in batches for at in range(0, part.num_rows, 512)):
            left = b.column(5).to_numpy().astype(np.int64)
            rows, right = aligned(left, b.column(6), spread, far)
            row, j = np.nonzero((left[:, None] >= low) & (right[:, None] >= short - high))
            hashes = window_hashes(rows, spread - low, low + short - high)[row, j]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(j.astype(np.int32)), pa.array(hashes.view(np.int64))], names=["gram", "ctx", "part", "h"])

    parts_ = scratch(slices.mapInArrow(shared, "gram long, ctx long, part int, h long"), "parts")
    key = ["gram", "part", "h"]
    twice = scratch(parts_.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "shared")
    able = heavy_join(parts_, twice, key, "n", n * len(low)).groupBy("gram", "ctx").agg(F.sum(F.expr("shiftleft(1, part)")).cast("int").alias("able"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.arange(spread + 1)
        part = np.searchsorted(high, x)
        for b in (p.slice(at, 256) for p in batches for at in range(0, p.num_rows, 256)):
            left, able = b.column(5).to_numpy().astype(np.int64), b.column(7).to_numpy()
            rows, right = aligned(left, b.column(6), spread, far)
            for k, rule in enumerate(rules):
                row, at = np.nonzero((left[:, None] >= x) & (right[:, None] >= rule.length - x) & (able[:, None] >> part & 1 > 0))
                hashes = window_hashes(rows, spread - x, np.full(len(x), rule.length))[row, at]
                columns = [b.column(i).take(pa.array(row)) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(row), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64))], names=["gram", "ctx", "t0", "t1", "rule", "x", "h"])

    each = slices.join(able, ["gram", "ctx"]).select("gram", "ctx", "t0", "t1", "hot", "lhs", "body", "able")
    each, n_each = counted(each.mapInArrow(windows, "gram long, ctx long, t0 long, t1 long, rule int, x int, h long"), "windows")
    key = ["gram", "rule", "x", "h"]
    across = F.element_at(F.array(*[F.lit(r.across) for r in rules]), F.col("rule") + 1)
    again = each.groupBy(*key).agg(F.count("*").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1")).where(F.when(across, F.col("t0") < F.col("t1")).otherwise(F.col("n") > 1))
    again = scratch(again.select(*key, "n"), "equal")
    size = F.element_at(F.array(*[F.lit(r.length) for r in rules]), F.col("rule") + 1)
    open_ = each.where("t0 = t1").select(*key, "ctx")  # contexts of two texts are settled whole
    return heavy_join(open_, again, key, "n", n_each).select("gram", "ctx", "rule", (-F.col("x")).alias("lo"), (size - F.col("x")).cast("int").alias("hi"))


class RepeatIndex:
    """Levels of texts and sorted anchors in the shared folder, for corpora that grow batch by batch.

    ``add`` takes a batch (tk, tl, text), gives it its sorted anchors, scans them against every level's for windows that
    both hold, and makes it a level; a level of less than twice the next one's size is merged with it, so there are as many
    levels as the logarithm of the batches, and a text is rewritten as often.
    """

    def __init__(self, *rules: Rule, gram: int = 64, most: int = 20_000):
        self.rules, self.gram, self.most = rules or (Rule(),), gram, most
        self.levels: list[tuple[int, DataFrame, DataFrame]] = []  # texts, their number, anchors

    def add(self, batch: DataFrame) -> DataFrame:
        """(tk, tl, spans) of all texts, old and new, that share a window with the batch (null-free keys; texts the index has are not new)."""
        for _, texts, _ in self.levels:
            batch = batch.join(texts.select(*KEY), KEY, "left_anti")
        texts = bucketed(batch.select(*KEY, "text").mapInArrow(_distinct, "tk long, tl long, text binary"), KEY, "level", _distinct)
        anchors = anchors_of(texts, self.rules, gram=self.gram)
        grams = anchors.select("gram").distinct()
        every, near = texts, anchors
        for _, old, sorted_ in self.levels:
            every, near = every.unionByName(old), near.unionByName(sorted_.join(grams, "gram", "left_semi"))
        found = repeated_windows(every, near, self.rules, gram=self.gram, most=self.most)
        self.levels.append((texts.count(), texts, anchors))
        while len(self.levels) > 1 and self.levels[-2][0] < 2 * self.levels[-1][0]:
            (m, a, x), (n, b, y) = self.levels[-2:]
            merged = bucketed(a.unionByName(b), KEY, "level", _distinct)
            self.levels[-2:] = [(m + n, merged, scratch(x.unionByName(y).repartition("gram").sortWithinPartitions("gram"), "anchors"))]
        return found


def keyed(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the SHA-256 of a text and its first 120 bits as two longs, ``tk`` and ``tl``."""
    df = df.withColumn("sha", F.sha2(text, 256))
    for n, name in enumerate(KEY):
        df = df.withColumn(name, F.conv(F.substring("sha", 1 + 15 * n, 15), 16, 10).cast("long"))
    return df


def repeated_bytes(df: DataFrame, *rules: Rule, id_col: str = "doc_id", text_col: str = "text", gram: int = 64, most: int = 20_000, kept: int | None = None, carry: Column | None = None) -> DataFrame:
    """One row per row: doc_id, n_bytes, and by the first rule n_removed, n_spans, kept_sha256.

    ``kept``: the number of the rule whose remaining text is a column as well (bytes of a character cut in two go);
    ``carry``: a column of each row to keep. ``most``: contexts of one gram that a task takes; grams with more are counted.
    """
    rules = rules or (Rule(),)
    short = min(r.length for r in rules)
    least = short if kept is None else max(short, rules[kept].length)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    docs = keyed(df.select(F.col(id_col).alias("doc_id"), text.alias("text"), *([] if carry is None else [carry.alias("carry")])), F.col("text"))
    size = F.octet_length("text").cast("long")
    small = [] if kept is None else [F.when(size < least, F.col("text")).alias("small")]
    rows, n_rows = counted(docs.select("doc_id", *KEY, "sha", size.alias("n_bytes"), *small, *([] if carry is None else ["carry"])), "rows")
    long = docs.where(size >= short).select(*KEY, "text")
    texts = bucketed(long.mapInArrow(_distinct, "tk long, tl long, text binary"), KEY, "texts", _distinct)
    spans = repeated_windows(texts, anchors_of(texts, rules, gram=gram), rules, gram=gram, most=most)
    spread = short - gram

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [*KEY, "removed", "spans", "kept_sha", "kept"], [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for b in pages(batches, 2):
            out = []
            for tk, tl, text, spans in zip(*(b.column(i) for i in range(4))):
                raw, spans = text.as_py(), spans.as_py()
                one = [tk.as_py(), tl.as_py(), 0, 0, None, None]
                for k, rule in enumerate(rules):
                    lo, hi = [], []
                    for s in spans:
                        if s["across"] or s["twice"] and not rule.across:
                            a, z = max(0, s["pos"] - spread), min(s["last"], len(raw) - rule.length)
                            if a <= z:
                                lo.append(a)
                                hi.append(z + rule.length)
                        else:
                            here = [f for f in s["found"] or () if f["rule"] == k]
                            lo += [s["pos"] + f["lo"] for f in here]
                            hi += [s["last"] + f["hi"] for f in here]
                    s, e = runs(np.array(lo), np.array(hi)) if lo else (np.zeros(0, np.int64),) * 2
                    if rule.words:
                        long = np.array([len(raw[i:j].split()) >= rule.words for i, j in zip(s.tolist(), e.tolist())], bool)
                        s, e = s[long], e[long]
                    if k and k != kept:
                        continue
                    left = b"".join(raw[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), len(raw)]))
                    if k == 0:
                        one[2:5] = [len(raw) - len(left), len(s), hashlib.sha256(left).hexdigest()]
                    if k == kept and len(s):
                        one[5] = left.decode("utf-8", "ignore").encode()
                if one[3] or one[5] is not None:
                    out.append(tuple(one))
            yield _batch(out, names, types)

    copies = scratch(rows.groupBy(*KEY).agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    done = texts.join(spans, KEY).select(*KEY, "text", "spans").mapInArrow(removed, "tk long, tl long, removed long, spans long, kept_sha string, kept binary")
    if kept is None:
        done = done.drop("kept")
    else:  # texts lie where they are; only what is left of those that were cut moves
        done = texts.join(done, KEY, "left").select(*KEY, "removed", "spans", "kept_sha", F.coalesce("kept", "text").alias("kept"))
    # rows of texts that many rows hold need no text: they go whole or are small
    many = F.broadcast(copies.where(F.col("copies") * 1000 > n_rows))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("removed", "long"), ("spans", "long"), ("kept_sha", "string"), *([("kept", "binary")] if kept is not None else []))]
    hot = rows.join(many, KEY).select("*", *nothing)
    rest = rows.join(many.select(*KEY), KEY, "left_anti").join(copies, KEY, "left").join(done, KEY, "left")
    done = hot.unionByName(rest)
    gone = lambda rule: (F.col("copies") > 1) & (F.col("n_bytes") >= rule.length)
    more = [] if kept is None else [F.when(gone(rules[kept]), F.lit(b"")).otherwise(F.coalesce("kept", "small")).cast("string").alias("kept")]
    return done.select(
        "doc_id", "n_bytes",
        F.when(gone(rules[0]), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone(rules[0]), 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone(rules[0]), EMPTY_SHA).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        *more, *([] if carry is None else ["carry"]),
    )
