"""Layouts of a venue out of its ways and relations, one row a venue in and one out.

A venue's elements are one array, so a row is all that a layout needs: rows go through Arrow batches where they are and
none is moved. See ``routes`` for what is done to chains and graphs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layouts import ALIASES, CALLED_MAIN, IS_MAIN, IS_OTHER, LIKE_TRACK, LONGEST, MAIN, METRES_A_POINT, OTHER, SAME_DEGREES, SAME_METRES, SAMPLES, SHORTER
from .routes import CLOSE_M, FUZZY, Branch, Chain, Node, Route, Section, Way, WayGraph, apart, best_component, box_area, closed_if_near, collapse_backtracks, end_gap, length, route, stitch, turn_reversed_sections, without_repeats

#: Names of pits, of layouts and of layouts that are shorter ones.
PIT = re.compile(r"pit[\s\-_]*lane|pit[\s\-_]*road|pitlane|pitroad|support[\s\-_]*pit|\bpit\s*$|boxen(?:stra[sß]e|gasse)", re.I)
LAYOUT = re.compile(r"\b(circuit|course|layout|oval|grand[\s_-]*prix|indy|national|endurance|inner|outer|short|chicane|bypass|long[\s_-]*lap|rallycross|moto[\s_-]*gp|alternate)\b", re.I)
SHORTCUT = re.compile(r"\b(inner|national|oasis|oval|s[uü]dschleife|test)\b", re.I)
#: Degrees within which a layout's ends meet a base, matches of an end, choices of branches, layouts of forks.
NEAR, MATCHES, CHOICES, FORKED = FUZZY * 8, 8, 8, 8
#: Metres and shares of a layout that is good enough, and of the names that win.
SPLICED_M, NAMED_M, SPLICED_GAP, NAMED_GAP, KNOWN_M, VARIANT_SHARE, NAME_SHARE, LONGER_M, OVERLAP = 1000.0, 1500.0, 0.2, 0.15, 250.0, 0.5, 0.35, 400.0, 0.5


def name_key(name: str | None) -> str:
    return re.sub(r"[^a-z0-9]+", " ", (name or "").lower()).strip()


def like(name: str | None, venue: str | None) -> bool:
    a, b = name_key(name), name_key(venue)
    return bool(a and b) and (a in b or b in a)


def folded(name: str) -> tuple[str, str]:
    """Order of a dictionary: without marks and case, then lower case first."""
    plain = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    return plain.lower(), name.swapcase()


@dataclass
class Layout:
    name: str
    nodes: Chain
    metres: float
    segments: int
    variants: int = 0
    rank: int = 0
    names: list[str] = field(default_factory=list)
    group: str = ""

    def score(self, venue: str | None) -> float:
        name = self.name.strip()
        points = ((like(name, venue), LIKE_TRACK), (re.search(MAIN, name), IS_MAIN), (name == "Main", CALLED_MAIN), (re.search(OTHER, name), IS_OTHER))
        return sum(n for test, n in points if test) + min(self.metres, LONGEST) / METRES_A_POINT


def ranked(layouts: list[Layout], venue: str | None) -> list[Layout]:
    def order(a: Layout, b: Layout) -> float:
        if a.rank != b.rank:
            return b.rank - a.rank
        for x, y in ((a.score(venue), b.score(venue)), (a.metres, b.metres)):
            if abs(x - y) > 1:
                return y - x
        p, q = folded(a.name), folded(b.name)
        return (p > q) - (p < q)

    return sorted(layouts, key=cmp_to_key(order))


def one_of_each_name(layouts: list[Layout], venue: str | None) -> list[Layout]:
    best: dict[str, Layout] = {}
    for x in layouts:
        key = name_key(x.name)
        best[key] = ranked([best[key], x], venue)[0] if key in best else x
    return list(best.values())


def _samples(chain: Chain, most: int = SAMPLES) -> Chain:
    ring = chain[:-1] if len(chain) > 1 else chain
    return ring if len(ring) <= most else [ring[i * len(ring) // most] for i in range(most)]


def one_of_each_way(layouts: list[Layout], venue: str | None) -> list[Layout]:
    """Ranked layouts without those that go the way of a better one; those of one group never do."""

    def alike(a: Layout, b: Layout) -> bool:
        covers = lambda x, y: all(positions(y.nodes, p, SAME_DEGREES, 1) for p in _samples(x.nodes))
        return not (a.group and a.group == b.group) and abs(a.metres - b.metres) <= SAME_METRES and covers(a, b) and covers(b, a)

    kept: list[Layout] = []
    for x in ranked(layouts, venue):
        if not any(alike(x, y) for y in kept):
            kept.append(x)
    return kept


def finished(layouts: list[Layout], venue: str | None) -> list[Layout]:
    """Known aliases named, one of each name, one of each way."""
    named = [replace(x, name=ALIASES.get(name_key(x.name), x.name)) for x in layouts]
    return one_of_each_way(one_of_each_name(named, venue), venue)


def positions(chain: Chain, node: Node, most: float, limit: int = MATCHES) -> list[tuple[int, float]]:
    """(place, distance) of a ring's nodes near ``node``, the nearest first."""
    ring = chain[:-1] if len(chain) > 1 else chain
    near = ((apart(p, node), n) for n, p in enumerate(ring))
    return [(n, d) for d, n in sorted(x for x in near if x[0] <= most)[:limit]]


def arc(chain: Chain, start: int, end: int) -> Chain:
    """A closed chain's nodes from one place to another, over its seam where need be."""
    ring = chain[:-1] if len(chain) > 1 else chain
    return ring[start : end + 1] if start <= end else ring[start:] + ring[: end + 1]


def turned(chain: Chain, start: Node, end: Node) -> Chain:
    """The way round that lies better between two nodes."""
    there, back = apart(chain[0], start) + apart(chain[-1], end), apart(chain[0], end) + apart(chain[-1], start)
    return chain[::-1] if back < there else chain


def splices(base: Chain, start: Node, end: Node) -> Iterator[tuple[Chain, Chain, float, float, bool]]:
    """(replaced, kept, distance of either end, whether it runs from start to end): the ways to open a closed chain near two nodes."""
    ends = positions(base, end, NEAR)
    for i, near in positions(base, start, NEAR):
        for j, far in ends:
            if i != j:
                one, two = arc(base, i, j), arc(base, j, i)
                yield one, two, near, far, True
                yield two, one, near, far, False


def known_length(label: str, hints: dict[str, float]) -> float | None:
    return next((m for pattern, m in hints.items() if re.search(pattern, name_key(label), re.I)), None)


def substituted(base: Chain, variant: Chain, metres: float, label: str, whole: float, hints: dict[str, float]) -> Route | None:
    """The best closed chain that takes the variant instead of a part of the base."""
    known, best, least = known_length(label, hints), None, math.inf
    for replaced, kept, near, far, _ in splices(base, variant[0], variant[-1]):
        if len(kept) < 2:
            continue
        made = route([Way(-1, kept, {"name": "Main"}), Way(-2, turned(variant, replaced[0], replaced[-1]), {"name": label})])
        short = SHORTCUT.search(label)
        gap = min(CLOSE_M, made.metres * SPLICED_GAP) if short else made.metres * SPLICED_GAP
        if len(made.nodes) < 4 or made.metres < SPLICED_M or made.gap > gap or known is not None and abs(made.metres - known) > KNOWN_M:
            continue
        if known is not None:
            off = abs(made.metres - known)
        else:
            off = made.metres if short else abs(made.metres - whole) + abs(length(replaced) - metres)
        if (score := (near + far) * 1e6 + off) < least:
            best, least = made, score
    return best


def branch_name(branch: Branch, graph: WayGraph, venue: str | None) -> str | None:
    """The name that holds most of a branch, where it and all names hold enough of it."""
    weights: dict[str, float] = {}
    for e in branch.edges:
        for name, _ in graph.ways[e].names():
            if name.lower() != (venue or "").lower():
                weights[name] = weights.get(name, 0.0) + graph.metres[e]
    best = max(weights, key=weights.get, default=None)
    enough = branch.metres * NAME_SHARE
    return best if best and weights[best] >= enough and sum(weights.values()) >= enough else None


def branch_labels(branches: list[Branch]) -> list[str]:
    if len(branches) == 2:
        first, second = sorted(branches, key=lambda b: (not b.on_backbone, -b.metres))
        if first.on_backbone or first.metres > 0 and second.metres / first.metres <= SHORTER:
            return ["Main" if b is first else "Alternate" for b in branches]
    return [f"Layout {chr(65 + n)}" for n in range(len(branches))]


def choices(sections: list[Section], most: int = CHOICES) -> Iterator[list[int]]:
    """The first ``most`` choices of a branch a section, the last section's varying fastest."""
    total = math.prod(len(s.branches) for s in sections)
    for n in range(min(most, total)):
        pick = []
        for s in reversed(sections):
            n, at = divmod(n, len(s.branches))
            pick.append(at)
        yield pick[::-1]


def forked_layouts(ways: list[Way], graph: WayGraph, sections: list[Section], venue: str | None, base: Chain) -> list[Layout]:
    """A layout for each choice of branches, spliced into the base; those that are short or stay open are none."""
    labels = [[branch_name(b, graph, venue) or label for b, label in zip(s.branches, branch_labels(s.branches))] for s in sections]
    shared = set(range(len(ways))) - {e for s in sections for b in s.branches for e in b.edges}
    out: list[Layout] = []
    for pick in choices(sections):
        nodes: Chain | None = base
        for section, at in zip(sections, pick):
            if at and nodes:
                nodes = _spliced(nodes, graph.node[section.fork], graph.node[section.merge], section.branches[at], section.branches[0])
        if not nodes:
            continue
        nodes = closed_if_near(nodes)
        whole = length(nodes)
        if len(nodes) < 4 or whole < SPLICED_M or end_gap(nodes) > CLOSE_M:
            continue
        named = [names[at] for names, at in zip(labels, pick)]
        edges = shared | {e for section, at in zip(sections, pick) for e in section.branches[at].edges}
        out.append(Layout(" + ".join(named) if any(pick) else "Main", nodes, whole, len(edges), sum(at > 0 for at in pick)))
    return out


def _spliced(base: Chain, fork: Node, merge: Node, branch: Branch, instead: Branch) -> Chain | None:
    best, least = None, math.inf
    for replaced, kept, near, far, ahead in splices(base, fork, merge):
        nodes = without_repeats(kept + turned(branch.nodes, *((fork, merge) if ahead else (merge, fork))))
        score = abs(length(replaced) - instead.metres) + end_gap(nodes) * 10 + near + far
        if len(kept) >= 2 and len(nodes) >= 4 and score < least:
            best, least = nodes, score
    return best


def layouts_of_ways(ways: list[Way], venue: str | None) -> list[Layout]:
    """Layouts of the forks on the backbone, or the one way round."""
    if not ways:
        return []
    graph, whole = WayGraph(ways), route(ways)
    backbone = graph.backbone()
    longer = whole.gap <= CLOSE_M and whole.metres > (backbone.metres if backbone else 0.0) + LONGER_M
    base = whole if longer else backbone
    sections = graph.sections(set(backbone.edges if backbone else ()))
    if base and len(found := forked_layouts(ways, graph, sections, venue, base.nodes)) > 1:
        return one_of_each_way(found[:FORKED], venue)
    one = base or whole
    return [Layout("Main", one.nodes, one.metres or sum(length(w.nodes) for w in ways), len(ways))] if len(one.nodes) >= 4 else []


@dataclass
class _Named:
    ways: list[Way] = field(default_factory=list)
    rank: int = 0

    def way_names(self) -> list[str]:
        return list(dict.fromkeys(n.strip() for w in self.ways if (n := w.tags.get("name")) and n.strip()))


def name_groups(ways: list[Way]) -> dict[str, _Named]:
    """Ways by each layout-like name they have."""
    groups: dict[str, _Named] = {}
    for way in ways:
        for name, rank in way.names():
            if LAYOUT.search(name):
                group = groups.setdefault(name, _Named())
                group.ways.append(way)
                group.rank = max(group.rank, rank)
    return groups


def _raw_names(ways: list[Way]) -> list[str]:
    return list(dict.fromkeys(w.tags["name"] for w in ways if w.tags.get("name") is not None))


def named_layouts(ways: list[Way], venue: str | None, reference: list[Way], hints: dict[str, float]) -> list[Layout]:
    """Layouts of layout-like names: those that are circuits of their own, others spliced into the best of them (or into what no name holds)."""
    groups = name_groups(ways)
    if len(groups) < 2:
        return []
    base = whole.nodes if (whole := route(reference)) else []
    eligible: dict[str, _Named] = {}
    alone: list[tuple[Layout, _Named]] = []
    for name, group in groups.items():
        others = [n for n in group.way_names() if LAYOUT.search(n) and name_key(n) != name_key(name)]
        own = route(group.ways)
        if group.rank == 0 and len(others) > 1 or not any(positions(base, p, NEAR, 1) for p in _samples(own.nodes, 12) if base):
            continue
        eligible[name] = group
        if len(own.nodes) >= 4 and own.metres >= NAMED_M and own.gap <= own.metres * NAMED_GAP:
            alone.append((Layout(name, own.nodes, own.metres, len(group.ways), 0, group.rank, group.way_names()), group))
    if not alone:
        return into_the_rest(eligible, reference, venue, hints) if len(eligible) > 1 else []
    best = ranked([x for x, _ in alone], venue)[0]
    ring = next(g for x, g in alone if x is best).ways
    found = one_of_each_way([x for x, _ in alone] + into_the_best(eligible, best, ring, hints), venue)
    found = one_of_each_way(found + implied_by_relations(groups, eligible, found, venue), venue)
    found = named_after_ways(found, venue)
    return found if len(found) > 1 else []


def into_the_best(groups: dict[str, _Named], best: Layout, ways: list[Way], hints: dict[str, float]) -> list[Layout]:
    graph = WayGraph(ways)
    ring = graph.ring(list(range(len(ways))))
    if ring is None:
        return []
    out = [Layout(best.name, best.nodes, best.metres, len(ways), 0, groups[best.name].rank, _raw_names(ways))]
    for name, group in groups.items():
        chain = without_repeats(stitch([w.nodes for w in group.ways]))
        if name != best.name and len(chain) > 1 and (made := substituted(ring.nodes, chain, sum(length(w.nodes) for w in group.ways), name, best.metres, hints)):
            out.append(Layout(name, made.nodes, made.metres, 2, 1, group.rank, _raw_names(group.ways)))
    return out if len(out) > 1 else []


def into_the_rest(groups: dict[str, _Named], reference: list[Way], venue: str | None, hints: dict[str, float]) -> list[Layout]:
    """Named variants, none a circuit of its own, spliced into the ways that no variant holds."""
    variants = {w.id for g in groups.values() for w in g.ways}
    rest = [w for w in reference if w.id not in variants]
    whole = route(rest)
    if whole is None or len(whole.nodes) < 4 or whole.gap > whole.metres * NAMED_GAP:
        return []
    base, out = closed_if_near(whole.nodes, whole.metres * NAMED_GAP), []
    for name, group in groups.items():
        chain, metres = without_repeats(stitch([w.nodes for w in group.ways])), sum(length(w.nodes) for w in group.ways)
        if len(chain) > 1 and metres <= whole.metres * VARIANT_SHARE and (made := substituted(base, chain, metres, name, whole.metres, hints)):
            out.append(Layout(name, made.nodes, made.metres, 2, 1, group="variants"))
    return [Layout("Main", base, whole.metres, len(rest), group="variants"), *one_of_each_way(out, venue)] if out else []


def implied_by_relations(groups: dict[str, _Named], eligible: dict[str, _Named], found: list[Layout], venue: str | None) -> list[Layout]:
    """Relations that have the venue's name and ways of one layout-like name that no layout has yet."""
    seen, out = {name_key(x.name) for x in found}, []
    for name, group in groups.items():
        if name in eligible or group.rank > 0 or not like(name, venue):
            continue
        names = [n for n in group.way_names() if LAYOUT.search(n)]
        missing = [n for n in names if name_key(n) != name_key(name) and name_key(n) not in seen]
        whole = route(group.ways)
        if len(missing) == 1 and len(whole.nodes) >= 4 and whole.metres >= NAMED_M and whole.gap <= whole.metres * NAMED_GAP:
            out.append(Layout(missing[0], whole.nodes, whole.metres, len(group.ways), 1, 1, names))
            seen.add(name_key(missing[0]))
    return out


def named_after_ways(layouts: list[Layout], venue: str | None) -> list[Layout]:
    """Layouts that have only the venue's name take the one layout-like name of their ways that none has."""
    seen = {name_key(x.name) for x in layouts}
    out = []
    for x in layouts:
        missing = [n for n in dict.fromkeys(x.names) if LAYOUT.search(n) and name_key(n) not in seen | {name_key(x.name)}]
        out.append(replace(x, name=missing[0], rank=1) if x.rank == 0 and like(x.name, venue) and len(missing) == 1 else x)
    return out


def ways_of(elements: list[dict]) -> list[Way]:
    """Ways of two nodes or more, and those that relations hold (but for pit lanes) with the relation's tags under their own."""
    ways: dict[int, Way] = {}
    nodes_of = lambda geometry: [(p["lat"], p["lon"]) for p in geometry or ()]
    for e in elements:
        nodes = nodes_of(e.get("geometry"))
        if e["type"] == "way" and e.get("id") is not None and len(nodes) > 1:
            ways.setdefault(e["id"], Way(e["id"], nodes, dict(e.get("tags") or {})))
    for e in elements:
        tags = dict(e.get("tags") or {})
        for m in (e.get("members") or ()) if e["type"] == "relation" else ():
            nodes = nodes_of(m.get("geometry"))
            if m["type"] != "way" or m.get("role") == "pit_lane" or m.get("ref") is None or len(nodes) < 2:
                continue
            old = ways.get(m["ref"])
            names = [n.strip() for n in (*(old.relations if old else ()), tags.get("name")) if n and n.strip()]
            ways[m["ref"]] = Way(m["ref"], nodes, tags | (old.tags if old else {}), list(dict.fromkeys(names)))
    return list(ways.values())


def or_all(rows: list, test) -> list:
    return [x for x in rows if test(x)] or rows


def with_named_ways(ways: list[Way], own: list[Way]) -> list[Way]:
    """The component's ways, and others of a layout-like name that begin and end near them."""
    base, held = (whole.nodes if (whole := route(own)) else []), {w.id for w in own}
    fits = lambda w: any(LAYOUT.search(n) for n, _ in w.names()) and base and all(positions(base, p, NEAR, 1) for p in (w.nodes[0], w.nodes[-1]))
    return own + [w for w in ways if w.id not in held and fits(w)]


def venue_layouts(elements: list[dict], venue: str | None, hints: dict[str, float] | None = None) -> tuple[list[Layout], list[str]] | None:
    """(layouts, names of the component's ways); None without ways."""
    ways, hints = ways_of(elements), hints or {}
    if not ways:
        return None
    racing = or_all(ways, lambda w: not PIT.search(w.tags.get("name") or ""))
    motor = or_all(racing, lambda w: (w.tags.get("sport") or "").strip().lower() in ("", "motor"))
    own = best_component(motor, lambda name: like(name, venue))
    names = sorted({n for w in own for n, _ in w.names()}, key=folded)
    found = named_layouts(with_named_ways(motor, own), venue, own, hints) or layouts_of_relations(elements, venue, hints) or layouts_of_ways(own, venue)
    if not found:
        nodes = stitch([w.nodes for w in best_component(own, lambda name: False)])
        return [Layout("Layout 1", nodes, sum(length(w.nodes) for w in own), len(own))], names
    return finished(found, venue), names


def layouts_of_relations(elements: list[dict], venue: str | None, hints: dict[str, float]) -> list[Layout]:
    """Relations that share less than half of their ways are circuits of their own; those that share more are variants of what all share."""
    relations = [e for e in elements if e["type"] == "relation"]
    if len(relations) < 2:
        return []
    members = [dict.fromkeys(m["ref"] for m in e.get("members") or ()) for e in relations]
    every = dict.fromkeys(r for refs in members for r in refs)
    shared = [r for r in every if all(r in refs for refs in members)]
    ways = {e["id"]: e for e in elements if e["type"] == "way"}
    names = [((e.get("tags") or {}).get("name") or "").strip() for e in relations]
    if every and len(shared) / len(every) < OVERLAP:
        out = []
        for e, name in zip(relations, names):
            parts = [{"type": "way", "id": m["ref"], "tags": ways.get(m["ref"], {}).get("tags"), "geometry": m["geometry"]} for m in e.get("members") or () if m["type"] == "way" and len(m.get("geometry") or ()) > 1]
            if got := venue_layouts([*parts, e], venue, hints):
                out += [replace(x, name=name or x.name) for x in got[0]]
        return out
    base = route(ways_of([ways[r] for r in shared if r in ways]))
    if len(set(filter(None, names))) < 2 or base is None or len(base.nodes) < 4 or base.gap > base.metres * NAMED_GAP:
        return []
    closed, out = closed_if_near(base.nodes, base.metres * NAMED_GAP), []
    for refs, name in zip(members, names):
        if not name:
            continue
        rest = [r for r in refs if r not in set(shared)]
        if not rest:
            out.append(Layout(name, closed, base.metres, base.segments))
            continue
        own = ways_of([ways[r] for r in rest if r in ways])
        chain = without_repeats(stitch([w.nodes for w in own]))
        if len(chain) > 1 and (made := substituted(closed, chain, sum(length(w.nodes) for w in own), name, base.metres, hints)):
            out.append(Layout(name, made.nodes, made.metres, 2, 1))
    return out if len(out) > 1 and len(finished(out, venue)) > 1 else []


NODE = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])
LAYOUT_ROW = pa.struct([("name", pa.string()), ("nodes", pa.list_(NODE)), ("metres", pa.float64()), ("area", pa.float64()), ("gap", pa.float64()), ("segments", pa.int32()), ("variants", pa.int32())])
LAYOUT_DDL = "struct<name:string,nodes:array<struct<lat:double,lon:double>>,metres:double,area:double,gap:double,segments:int,variants:int>"


def chain_rows(nodes: Chain) -> list[dict]:
    return [{"lat": a, "lon": b} for a, b in nodes]


RESULT_ROW = pa.struct([("layouts", pa.list_(LAYOUT_ROW)), ("names", pa.list_(pa.string())), ("error", pa.string())])
#: Bytes of results that a worker keeps for venues equal to one it has seen.
KEPT_BYTES = 64 << 20
_places: dict[str, int] = {}
_kept: list[pa.StructArray] = []


def _result(name: str | None, hints: list | None, elements: list[dict] | None) -> dict:
    rows = [{**e, "tags": dict(e.get("tags") or ())} for e in elements or ()]
    got = venue_layouts(rows, name, dict(hints or ()))
    if not got:
        return {"layouts": None, "names": None, "error": "no ways"}
    return {"layouts": [{"name": x.name, "nodes": chain_rows(x.nodes), "metres": x.metres, "area": box_area(x.nodes), "gap": end_gap(x.nodes), "segments": x.segments, "variants": x.variants} for x in got[0]], "names": got[1], "error": None}


def layout_results(digests: list[str], name: pa.Array, hints: pa.Array, elements: pa.Array) -> pa.StructArray:
    """A result for each venue; venues of one digest are laid out once, as long as the worker keeps the result."""
    if _kept and _kept[0].nbytes > KEPT_BYTES:
        _kept.clear()
        _places.clear()
    begin = len(_kept[0]) if _kept else 0
    first = {d: i for i, d in reversed(list(enumerate(digests))) if d not in _places}
    if first:
        new = pa.array([_result(*(c[i].as_py() for c in (name, hints, elements))) for i in first.values()], RESULT_ROW)
        _kept[:] = [pa.concat_arrays([*_kept, new])]
        _places.update(zip(first, range(begin, begin + len(new))))
    return _kept[0].take(pa.array([_places[d] for d in digests], pa.int64()))


def build_layouts(venues: DataFrame, batch_rows: int = 1024) -> DataFrame:
    """(track, name, hints map<string, double>, elements) -> (track, layouts, names, error).

    ``elements``: structs of type, id, tags map, geometry array<struct<lat, lon>>, members array<struct<type, ref, role,
    geometry>>. Null elements count as none; a venue without ways has null layouts and an error. Venues equal in all but
    their track (by SHA-256 of their JSON) are laid out once a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch_rows):
                part = b.slice(at, batch_rows)
                out = layout_results(part.column(1).to_pylist(), *(part.column(i) for i in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays([part.column(0), *out.flatten()], names=["track", "layouts", "names", "error"])

    kind = venues.schema["track"].dataType.simpleString()
    digest = F.sha2(F.to_json(F.struct("name", "hints", "elements"), {"ignoreNullFields": "false"}), 256)
    return venues.select("track", digest.alias("digest"), "name", "hints", "elements").mapInArrow(run, f"track {kind}, layouts array<{LAYOUT_DDL}>, names array<string>, error string")


def best_routes(venues: DataFrame) -> DataFrame:
    """(track, name, ways array<struct<id, name, nodes>>) -> (track, ways, nodes, metres, area, gap): the best component and its route."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for venue, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ways = [Way(w["id"], [(p["lat"], p["lon"]) for p in w["nodes"]], {"name": w["name"]}) for w in rows or () if len(w["nodes"] or ()) > 1]
                own = best_component(ways, lambda name, venue=venue: like(name, venue))
                whole = route(own)
                out.append(([w.id for w in own], chain_rows(whole.nodes), whole.metres, whole.area, whole.gap) if whole else (None,) * 5)
            columns = zip(*out)
            types = (pa.list_(pa.int64()), pa.list_(NODE), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["track", "ways", "nodes", "metres", "area", "gap"])

    kind = venues.schema["track"].dataType.simpleString()
    return venues.select("track", "name", "ways").mapInArrow(run, f"track {kind}, ways array<bigint>, nodes array<struct<lat:double,lon:double>>, metres double, area double, gap double")


def cleaned_chains(chains: DataFrame) -> DataFrame:
    """(chain, nodes) -> (chain, nodes): repeats and backtracks gone, reversed sections turned, closed where the ends are near. Null nodes stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rows in b.column(1).to_pylist():
                nodes = None if rows is None else closed_if_near(turn_reversed_sections(collapse_backtracks(without_repeats([(p["lat"], p["lon"]) for p in rows]))))
                out.append(None if nodes is None else chain_rows(nodes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(NODE))], names=["chain", "nodes"])

    kind = chains.schema["chain"].dataType.simpleString()
    return chains.select("chain", "nodes").mapInArrow(run, f"chain {kind}, nodes array<struct<lat:double,lon:double>>")
