"""Loops that a venue's ways make, one row a venue: ways cut at junctions, simple loops, loops written as ways with anchors."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from .routes import Chain, Node, Way, length

#: Degrees (each) within which two ways' nodes are one, decimals of a place.
SAME, DECIMALS = 1e-7, 5


@dataclass(frozen=True)
class Limits:
    """Segments of the longest loop, metres of the shortest and longest, and how many are looked for (the limit is the feature)."""

    edges: int = 30
    shortest: float = 500.0
    longest: float = 30_000.0
    loops: int = 500


@dataclass
class Segment:
    id: int
    way: Way
    first: int
    last: int
    a: str
    b: str
    metres: float


def place(node: Node) -> str:
    return ",".join(f"{x:.{DECIMALS}f}" for x in node)


def junctions(ways: list[Way]) -> set[str]:
    """Places of the ends of ways, and of nodes that two ways have."""
    out = {place(w.nodes[n]) for w in ways if len(w.nodes) > 1 for n in (0, -1)}
    held: dict[str, list[tuple[int, Node]]] = {}
    for w in ways:
        for node in w.nodes:
            held.setdefault(place(node), []).append((w.id, node))
    one = lambda p, q: abs(p[0] - q[0]) < SAME and abs(p[1] - q[1]) < SAME
    return out | {k for k, refs in held.items() if k not in out and any(i != j and one(p, q) for n, (i, p) in enumerate(refs) for j, q in refs[n + 1 :])}


def segments(ways: list[Way], at: set[str]) -> list[Segment]:
    """Ways cut at junctions."""
    out: list[Segment] = []
    for w in ways:
        cuts = [n for n, node in enumerate(w.nodes) if n in (0, len(w.nodes) - 1) or place(node) in at]
        out += [Segment(len(out) + k, w, a, b, place(w.nodes[a]), place(w.nodes[b]), length(w.nodes[a : b + 1])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def simple_loops(parts: list[Segment], limits: Limits) -> list[list[Segment]]:
    """Each set of segments once, from its smallest place, in the order they are found depth first."""
    near: dict[str, list[tuple[Segment, str]]] = {}
    for s in parts:
        if s.a != s.b:
            near.setdefault(s.a, []).append((s, s.b))
            near.setdefault(s.b, []).append((s, s.a))
    found: dict[tuple[int, ...], list[Segment]] = {}
    for start in sorted(near):
        path, seen, far, todo = [], [start], [0.0], [iter(near[start])]
        while todo and len(found) < limits.loops:
            step = next(todo[-1], None)
            if step is None:
                todo.pop(), seen.pop(), far.pop()
                if path:
                    path.pop()
                continue
            segment, to = step
            total = far[-1] + segment.metres
            if segment in path:
                continue
            if to == start:
                if path and limits.shortest <= total <= limits.longest:
                    walk = [*path, segment]
                    found.setdefault(tuple(sorted(s.id for s in walk)), walk)
            elif to > start and to not in seen and total <= limits.longest and len(path) + 1 < limits.edges:
                path.append(segment), seen.append(to), far.append(total), todo.append(iter(near[to]))
    return list(found.values())


def written(walk: list[Segment], parts_of: Counter) -> dict:
    """A loop as ways in order, with anchors where only a part of a way is gone; a way at both ends of the walk is one."""
    runs = [list(run) for _, run in groupby(walk, key=lambda s: s.way.id)]
    if len(runs) > 1 and runs[0][0].way.id == runs[-1][0].way.id:
        runs[0] = runs.pop() + runs[0]
    ways = []
    for run in runs:
        way, first, last = run[0].way, min(s.first for s in run), max(run, key=lambda s: s.first).last
        whole = len(run) == parts_of[way.id]
        anchor = lambda n, none: None if whole or n == none else {"lat": way.nodes[n][0], "lon": way.nodes[n][1]}  # noqa: B023, E731
        ways.append({"way_id": way.id, "from_node": anchor(first, 0), "to_node": anchor(last, len(way.nodes) - 1)})
    names = sorted({n for s in walk if (n := s.way.tags.get("name"))})
    return {"metres": math.floor(sum(s.metres for s in walk) + 0.5), "way_count": len(runs), "names": names, "ways": ways}


def loops_of(ways: list[Way], limits: Limits = Limits()) -> dict:
    """Loops by length, the shortest first, and the ways that none goes."""
    at = junctions(ways)
    parts = segments(ways, at)
    parts_of = Counter(s.way.id for s in parts)
    loops = sorted((written(walk, parts_of) for walk in simple_loops(parts, limits)), key=lambda x: x["metres"])
    loops = [{"loop": n, **x} for n, x in enumerate(loops, 1)]
    used = {w["way_id"] for x in loops for w in x["ways"]}
    unused = [{"way_id": w.id, "name": w.tags.get("name") or ""} for w in ways if w.id not in used]
    return {"junctions": len(at), "segments": len(parts), "loops": loops, "unused": unused}


def sliced(nodes: Chain, start: Node | None, end: Node | None, way: int = 0) -> Chain:
    """Nodes from one anchor to the next one after it that is the other; an anchor that is none of them is an error."""

    def find(name: str, anchor: Node | None, begin: int, none: int) -> int:
        if anchor is None:
            return none
        at = next((n for n in range(begin, len(nodes)) if all(abs(x - y) < SAME for x, y in zip(nodes[n], anchor))), None)
        if at is None:
            raise ValueError(f"Way {way}: {name} ({anchor[0]}, {anchor[1]}) does not match any node in the way")
        return at

    first = find("fromNode", start, 0, 0)
    return nodes[first : find("toNode", end, first, len(nodes) - 1) + 1]


_NODE = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])
_WAY = pa.struct([("way_id", pa.int64()), ("from_node", _NODE), ("to_node", _NODE)])
_LOOP = pa.struct([("loop", pa.int32()), ("metres", pa.int64()), ("way_count", pa.int32()), ("names", pa.list_(pa.string())), ("ways", pa.list_(_WAY))])
_UNUSED = pa.struct([("way_id", pa.int64()), ("name", pa.string())])
_DDL = "junctions int, segments int, loops array<struct<loop:int,metres:bigint,way_count:int,names:array<string>,ways:array<struct<way_id:bigint,from_node:struct<lat:double,lon:double>,to_node:struct<lat:double,lon:double>>>>>, unused array<struct<way_id:bigint,name:string>>"


def find_loops(venues: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(track, ways array<struct<id, tags, nodes>>) -> (track, junctions, segments, loops, unused). Null ways count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [loops_of([Way(w["id"], [(p["lat"], p["lon"]) for p in w["nodes"]], dict(w["tags"] or ())) for w in ways or ()], limits) for ways in b.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in (("junctions", pa.int32()), ("segments", pa.int32()), ("loops", pa.list_(_LOOP)), ("unused", pa.list_(_UNUSED)))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["track", "junctions", "segments", "loops", "unused"])

    kind = venues.schema["track"].dataType.simpleString()
    return venues.select("track", "ways").mapInArrow(run, f"track {kind}, {_DDL}")
