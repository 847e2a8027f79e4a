"""Parts of a way graph, (track, eid, a, b, length): branches from junction to junction, forks, and closed rings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut

#: Edges of a track up to which one task walks it, with others; rows that a task walks at once; buckets of tracks by which their edges are bounded.
MOST_EDGES, AT_ONCE, BUCKETS = 1_000_000, 100_000, 65_536
#: Types that Arrow tells apart as Spark does.
PLAIN = {"tinyint", "smallint", "int", "bigint", "string", "date", "binary"}


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: (track, at, to, eid, length)."""
    e = edges.select("track", "eid", "a", "b", F.col("length").cast("double").alias("length"))
    return e.select("track", F.col("a").alias("at"), F.col("b").alias("to"), "eid", "length").unionByName(e.select("track", F.col("b").alias("at"), F.col("a").alias("to"), "eid", "length"))


def walked(t: pa.Table) -> pa.Table:
    """Branches of one or more whole tracks (track, eid, a, b, length, main), all at once, a step of every branch a turn; see ``_branches``."""
    t = t.combine_chunks()
    n, column = t.num_rows, lambda name: t[name].chunk(0)
    codes = lambda values: values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, eids, length = pa.concat_arrays([column("a"), column("b")]), column("eid"), column("length")
    tracks, vertex, eid = codes(column("track")), codes(ends), codes(eids)
    key = np.tile(tracks, 2) * (vertex.max() + 1) + vertex
    _, at = np.unique(key, return_inverse=True)
    at = np.where(vertex >= 0, at, -1)
    # Arc i goes from end i to end twin[i]; both are of edge[i].
    twin, edge = np.roll(np.arange(2 * n), -n), np.tile(np.arange(n), 2)
    to = at[twin]
    degree = np.bincount(at[at >= 0], minlength=at.max() + 2)
    order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
    first = (np.cumsum(degree) - degree)[degree == 2]
    other = np.full(2 * n, -1)
    other[order[first]], other[order[first + 1]] = order[first + 1], order[first]
    after = np.where(to >= 0, other[twin], -1)
    known = after >= 0
    x, y = eid[edge], eid[edge[after]]
    after = np.where(known & (x >= 0) & (y >= 0) & (x != y), after, -1)
    main = column("main").to_numpy(zero_copy_only=False)
    metres, missing = length.fill_null(0.0).to_numpy(zero_copy_only=False), length.is_null().to_numpy(zero_copy_only=False)
    near = np.zeros(len(degree), bool)
    near[at[(at >= 0) & np.tile(main, 2)]] = True
    starts = np.flatnonzero((at >= 0) & (to >= 0) & (degree[at] >= 3))
    total, unknown, own, last = np.zeros(len(starts)), np.zeros(len(starts), bool), np.zeros(len(starts), bool), starts.copy()
    which, arc, steps = np.arange(len(starts)), starts, []
    while len(which):
        e = edge[arc]
        steps.append((which, e))
        total[which] += metres[e]
        unknown[which] |= missing[e]
        own[which] |= main[e]
        last[which] = arc
        more = after[arc] >= 0
        which, arc = which[more], after[arc[more]]
    end = to[last]
    kept = (end >= 0) & (degree[end] != 2) & (end != at[starts])
    place, on = (np.concatenate(c) for c in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 2
    place, on = place[kept[place]], on[kept[place]]
    by = np.argsort(place, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(starts))[kept])])
    begin, last, end = starts[kept], last[kept], end[kept]
    out = {
        "track": column("track").take(pa.array(edge[begin])), "fork": ends.take(pa.array(begin)), "merge": ends.take(pa.array(twin[last])), "eids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), eids.take(pa.array(on[by]))),
        "length": pa.array(total[kept], mask=unknown[kept]), "on_backbone": pa.array(own[kept]), "ends": pa.array(degree[end].astype(np.int64)), "near": pa.array(near[at[begin]] & near[end]),
    }
    return pa.table(out)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by tracks; what may go on in the next batch waits."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, AT_ONCE
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= enough:
            t = pa.Table.from_batches(held).combine_chunks()
            same = t["track"].chunk(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            whole = int(np.argmax(same == same[-1]))
            if whole:
                yield from walked(t.slice(0, whole)).to_batches()
            held, rows = t.slice(whole).to_batches(), t.num_rows - whole
            enough = max(AT_ONCE, 2 * rows)
    if rows:
        yield from walked(pa.Table.from_batches(held)).to_batches()


def _branches(edges: DataFrame, most: int) -> DataFrame:
    """Branches with ``on_backbone`` (an edge is ``main``), ``ends`` (edges at merge) and ``near`` (both junctions have a main edge).

    Tracks of up to ``most`` edges are sorted into partitions and walked there; longer ones, if a bucket of tracks shows
    that there may be any, are walked by joins.
    """
    e = edges.where("track is not null").select("track", "eid", "a", "b", F.col("length").cast("double").alias("length"), F.coalesce("main", F.lit(False)).alias("main"))
    kind = {f.name: f.dataType.simpleString() for f in e.schema}
    if not {kind[c] for c in ("track", "eid", "a", "b")} <= PLAIN or kind["a"] != kind["b"]:
        return _long_branches(e)
    full = e.groupBy(F.pmod(F.hash("track"), F.lit(BUCKETS))).agg(F.count("*").alias("n")).where(F.col("n") > most)
    short, long = e, None
    if not full.isEmpty():
        many = e.groupBy("track").agg(F.count("*").alias("n")).where(F.col("n") > most).select("track")
        short, long = e.join(many, "track", "left_anti"), _long_branches(e.join(many, "track", "left_semi"))
    ddl = f"track {kind['track']}, fork {kind['a']}, merge {kind['a']}, eids array<{kind['eid']}>, length double, on_backbone boolean, ends bigint, near boolean"
    found = short.repartition("track").sortWithinPartitions("track").mapInArrow(_walk, ddl)
    return found if long is None else found.unionByName(long)


def branches(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(track, fork, merge, eids, length): ways from a vertex of three edges or more over vertices of two, to the next that has not two.

    Ways that come back to themselves are none.
    """
    return _branches(edges.withColumn("main", F.lit(False)), most).select("track", "fork", "merge", "eids", "length")


def _long_branches(edges: DataFrame) -> DataFrame:
    """``_branches`` of tracks of any size. Each direction of an edge points at the one before it, over a vertex of two;
    pointers double until all are at a begin, so rounds (an equi-join and a checkpoint each) are the logarithm of the
    longest way. Rings without a begin never get there and are dropped.
    """
    e = edges.select("track", "eid", "a", "b", F.col("length").cast("double").alias("length"))
    way = lambda n, a, b: e.select("track", F.struct("eid", F.lit(n).alias("way")).alias("arc"), F.col(a).alias("at"), F.col(b).alias("to"), "length")
    both = way(0, "a", "b").unionByName(way(1, "b", "a"))
    degree = cut(both.groupBy("track", F.col("at").alias("v")).agg(F.count("*").alias("n")))
    of = lambda end: degree.select("track", F.col("v").alias(end), F.col("n").alias(f"n_{end}"))
    every = cut(both.join(of("at"), ["track", "at"]).join(of("to"), ["track", "to"]))
    before = every.select("track", F.col("to").alias("at"), F.col("arc").alias("up"))
    inner = every.where("n_at = 2").join(before, ["track", "at"]).where("up.eid <> arc.eid").select("track", "arc", "up", F.lit(1).cast("long").alias("steps"))
    state = cut(every.select("track", "arc").join(inner, ["track", "arc"], "left").select("track", "arc", F.coalesce("up", "arc").alias("up"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps")))
    done = state.agg(F.count("*"), F.sum("steps")).first()
    for _ in range((done[0] or 0).bit_length() + 1):
        far = state.select("track", F.col("arc").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"))
        state = cut(state.join(far, ["track", "up"]).select("track", "arc", F.col("top").alias("up"), (F.col("steps") + F.col("more")).alias("steps")))
        total = state.agg(F.sum("steps")).first()[0]
        if total == done[1]:
            break
        done = (done[0], total)
    begins = every.where("n_at >= 3").select("track", F.col("arc").alias("up"), F.col("at").alias("fork"))
    step = F.struct("steps", F.col("arc.eid").alias("eid"), "to", "n_to", "length")
    paths = state.join(begins, ["track", "up"]).join(every, ["track", "arc"]).groupBy("track", "up", "fork").agg(F.array_sort(F.collect_list(step)).alias("path"))
    last = F.element_at("path", -1)
    paths = paths.where((last["n_to"] != 2) & (last["to"] != F.col("fork")))
    ways = paths.select("track", "fork", last["n_to"].alias("ends"), last["to"].alias("merge"), F.transform("path", lambda s: s["eid"]).alias("eids"), F.aggregate("path", F.lit(0.0), lambda t, s: t + s["length"]).alias("length"))
    on = edges.where("main").groupBy("track").agg(F.collect_set("eid").alias("own"))
    near = edges.where("main").select("track", F.explode(F.array("a", "b")).alias("v")).distinct()
    ways = ways.join(on, "track", "left").withColumn("on_backbone", F.coalesce(F.arrays_overlap("eids", "own"), F.lit(False))).drop("own")
    for end in ("fork", "merge"):
        ways = ways.join(near.select("track", F.col("v").alias(end), F.lit(True).alias(f"at_{end}")), ["track", end], "left")
    both = F.coalesce(F.col("at_fork") & F.col("at_merge"), F.lit(False))
    return ways.select("track", "fork", "merge", "eids", "length", "on_backbone", "ends", both.alias("near"))


def fork_sections(edges: DataFrame, backbone: Column | None = None, most: int = MOST_EDGES) -> DataFrame:
    """(track, fork, merge, branches, total): two branches or more between two junctions, ``fork`` being the smaller one.

    ``branches``: structs (on_backbone, length, eids), those on the backbone first, then the longest. With a ``backbone``
    (a test on edges) both junctions must lie on it, and one branch. An edge is in one branch and a branch between one
    pair of junctions, so sections never share an edge.
    """
    marked = edges.withColumn("main", F.lit(False) if backbone is None else backbone)
    ways = _branches(marked, most).where("fork < merge and ends >= 3" + (" and near" if backbone is not None else ""))
    one = F.struct("on_backbone", "length", "eids")
    rank = lambda x, y: F.when(x["on_backbone"] != y["on_backbone"], F.when(x["on_backbone"], -1).otherwise(1)).when(x["length"] > y["length"], -1).when(x["length"] < y["length"], 1).when(x["eids"] < y["eids"], -1).otherwise(1)
    found = ways.groupBy("track", "fork", "merge").agg(F.array_sort(F.collect_list(one), rank).alias("branches"), F.sum("length").alias("total"), F.max("on_backbone").alias("any_main")).where(F.size("branches") >= 2)
    if backbone is not None:
        found = found.where("any_main")
    return found.select("track", "fork", "merge", "branches", "total")


def rings(edges: DataFrame) -> DataFrame:
    """(track, eids, length) of tracks whose edges are one ring: every vertex has two ends and one walk meets all edges.

    The walk starts at the smallest edge, from ``a`` to ``b``. Tracks of which a vertex has not two are dropped before
    any edges are gathered; what is left of a track is one ring's edges.
    """
    ends = arcs(edges).groupBy("track", "at").agg(F.count("*").alias("n")).where("n <> 2").select("track").distinct()
    whole = edges.join(ends, "track", "left_anti").select("track", "eid", "a", "b", F.col("length").cast("double").alias("length"))
    kind = {f.name: f.dataType.simpleString() for f in whole.schema}

    def walk(e: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values("eid")
        ways = {k: (x, y) for k, x, y in zip(e["eid"], e["a"], e["b"])}
        touching: dict = {}
        for k, (x, y) in ways.items():
            for v in (x, y):
                touching.setdefault(v, []).append(k)
        path, (_, at) = [e["eid"].iloc[0]], ways[e["eid"].iloc[0]]
        while (to := [k for k in touching[at] if k != path[-1]]) and to[0] != path[0]:
            path.append(to[0])
            x, y = ways[to[0]]
            at = y if at == x else x
        ring = pd.DataFrame({"track": [e["track"].iloc[0]], "eids": [path], "length": [e["length"].sum()]})
        return ring[[len(path) == len(ways)]]

    return whole.groupBy("track").applyInPandas(walk, f"track {kind['track']}, eids array<{kind['eid']}>, length double")
