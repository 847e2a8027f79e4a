"""Layouts of one track, (track, track_name, layouts array<struct<name, source_rank, metres, group, nodes>>): ranks, duplicates, branches.

A track has few layouts, so each operator is one expression on a row's array: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import grid

#: Words of main and of other layouts, names with a known alias, and the points they give.
MAIN = r"(?i)\b(main|grand[\s_-]*prix)\b"
OTHER = r"(?i)\b(alternate|alternative|club|corkscrew|endurance|formula\s*e|e[\s_-]*prix|flat|inner|joker|kart|moto|national|outer|oval|paddock|rallycross|short|test)\b"
ALIASES = {"flat oval layout": "Test Oval", "bahrain oval gp": "Test Oval"}
LIKE_TRACK, IS_MAIN, CALLED_MAIN, IS_OTHER, LONGEST, METRES_A_POINT = 420, 520, 260, -360, 9000, 20
#: Metres by which copies may differ, degrees (sum of both) between their samples, samples.
SAME_METRES, SAME_DEGREES, SAMPLES = 250, 3e-4 * 4, 24
#: Share up to which the shorter of two branches is the other way round.
SHORTER = 0.92


def names_match(name: Column, track: Column) -> Column:
    """One name's key holds the other's; empty names match nothing."""
    a, b = text.name_key(F.coalesce(name, F.lit(""))), text.name_key(F.coalesce(track, F.lit("")))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def canonical_name(name: Column) -> Column:
    key, out = text.name_key(F.coalesce(name, F.lit(""))), name
    for alias, better in ALIASES.items():
        out = F.when(key == alias, better).otherwise(out)
    return out


def score(name: Column, metres: Column, track: Column) -> Column:
    name = F.trim(F.coalesce(name, F.lit("")))
    points = [(names_match(name, track), LIKE_TRACK), (F.regexp_like(name, F.lit(MAIN)), IS_MAIN), (name == "Main", CALLED_MAIN), (F.regexp_like(name, F.lit(OTHER)), IS_OTHER)]
    return sum((F.when(test, n).otherwise(0) for test, n in points), F.least(F.coalesce(metres, F.lit(0.0)), F.lit(float(LONGEST))) / METRES_A_POINT)


def compare(track: Column):
    """Comparator of two layouts, the better first: rank of the name's source, score and length (where over 1 apart), name.

    Names are compared without marks and case, then lower case first, as a dictionary has them.
    """
    by = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)
    fold = lambda n: F.lower(text.strip_latin_marks(F.coalesce(n, F.lit(""))))

    def order(a: Column, b: Column) -> Column:
        ranks = [F.coalesce(x["source_rank"], F.lit(0)) for x in (a, b)]
        scores = [score(x["name"], x["metres"], track) for x in (a, b)]
        metres = [F.coalesce(x["metres"], F.lit(0.0)) for x in (a, b)]
        folded = [fold(x["name"]) for x in (a, b)]
        wide = lambda p: F.abs(p[0] - p[1]) > 1
        named = F.when(folded[0] != folded[1], by(*folded)).otherwise(by(b["name"], a["name"]))
        return F.coalesce(F.when(ranks[0] != ranks[1], by(ranks[1], ranks[0])).when(wide(scores), by(scores[1], scores[0])).when(wide(metres), by(metres[1], metres[0])).otherwise(named), F.lit(0)).cast("int")

    return order


def rank(tracks: DataFrame) -> DataFrame:
    """``layouts`` in order, the best first."""
    return tracks.withColumn("layouts", F.array_sort("layouts", compare(F.col("track_name"))))


def one_of_each_name(tracks: DataFrame) -> DataFrame:
    """The best layout of each name's key, in order of the keys' first use."""
    order, key = compare(F.col("track_name")), lambda x: text.name_key(F.coalesce(x["name"], F.lit("")))
    kind = tracks.schema["layouts"].dataType.simpleString()
    keys = F.array_distinct(F.transform("layouts", key))

    def best(k: Column) -> Column:
        same = F.filter("layouts", lambda x: key(x) == k)
        return F.aggregate(same, F.get(same, F.lit(0)), lambda kept, x: F.when(order(x, kept) < 0, x).otherwise(kept))

    return tracks.withColumn("layouts", F.transform(keys, best).cast(kind))


def _ring(nodes: Column) -> Column:
    """Without the node that closes it."""
    nodes = F.coalesce(nodes, F.array().cast("array<struct<lat:double,lon:double>>"))
    return F.when(F.size(nodes) > 1, F.slice(nodes, F.lit(1), F.size(nodes) - 1)).otherwise(nodes)


def _spread(ring: Column) -> Column:
    picks = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.get(ring, F.floor(i * F.size(ring) / SAMPLES).cast("int")))
    return F.when(F.size(ring) <= SAMPLES, ring).otherwise(picks)


def alike(a: Column, b: Column) -> Column:
    """Layouts of about one length whose samples all lie near the other; those of one group never are."""
    near = lambda p, ring: F.exists(ring, lambda q: F.abs(p["lat"] - q["lat"]) + F.abs(p["lon"] - q["lon"]) <= SAME_DEGREES)
    covered = lambda x, y: F.forall(_spread(_ring(x["nodes"])), lambda p: near(p, _ring(y["nodes"])))
    related = F.coalesce((a["group"] != "") & (a["group"] == b["group"]), F.lit(False))
    close = F.abs(F.coalesce(a["metres"], F.lit(0.0)) - F.coalesce(b["metres"], F.lit(0.0))) <= SAME_METRES
    return ~related & close & covered(a, b) & covered(b, a)


def one_of_each_way(tracks: DataFrame) -> DataFrame:
    """Ranked layouts without those alike to a better one."""
    ranked = rank(tracks)
    return ranked.withColumn("layouts", grid.keep_unlike(F.col("layouts"), tracks.schema["layouts"].dataType.simpleString(), alike))


def normalise(tracks: DataFrame) -> DataFrame:
    """Known aliases named, then one layout of each name and of each way round."""
    named = F.transform("layouts", lambda x: x.withField("name", canonical_name(x["name"])))
    return one_of_each_way(one_of_each_name(tracks.withColumn("layouts", named)))


def branch_labels(branches: Column) -> Column:
    """array<struct<key, length, on_backbone>> -> array<struct<key, label>>: ``Main`` and ``Alternate``, or ``Layout A`` and on."""
    sorted_two = F.array_sort(branches, lambda a, b: F.when(a["on_backbone"] != b["on_backbone"], F.when(a["on_backbone"], -1).otherwise(1)).when(a["length"] > b["length"], -1).when(a["length"] < b["length"], 1).otherwise(0))
    first, second = F.get(sorted_two, F.lit(0)), F.get(sorted_two, F.lit(1))
    clear = (F.size(branches) == 2) & (first["on_backbone"] | ((first["length"] > 0) & (second["length"] / F.nullif(first["length"], F.lit(0.0)) <= SHORTER)))
    label = lambda b, name: F.struct(b["key"].alias("key"), name.alias("label"))
    letters = F.transform(branches, lambda b, i: label(b, F.concat(F.lit("Layout "), F.char(i + 65))))
    return F.when(F.coalesce(clear, F.lit(False)), F.array(label(first, F.lit("Main")), label(second, F.lit("Alternate")))).otherwise(letters)


def branch_choices(sections: Column, most: int = 8) -> Column:
    """array<array<T>> of branches -> the first ``most`` choices of one a section, the last section's varying fastest.

    The n-th choice is written in mixed radix, so that none is built to be dropped; an empty section leaves none. The
    limit is the feature: the number of choices is a product.
    """
    count = F.aggregate(sections, F.lit(1), lambda n, s: F.least(n * F.size(s), F.lit(1 << 20)))
    after = lambda i: F.aggregate(F.slice(sections, i + 2, F.size(sections)), F.lit(1), lambda n, s: F.least(n * F.size(s), F.lit(1 << 20)))
    pick = lambda n: F.transform(sections, lambda s, i: F.get(s, (F.floor(n / after(i)) % F.size(s)).cast("int")))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.least(count, F.lit(most)) - 1), pick)).otherwise(F.array())
