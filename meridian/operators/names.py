"""Printed venue names: candidates of a row, which of them stay, the best one, and the layout's suffix.

A row's few names are one array of structs; every step is an array function, so no row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Word patterns of venue and layout names.
STRONG = r"(?i)\b(International Circuit|Motor Speedway|Park Circuit|Circuit|Autodrome|Autodromo|Raceway|Speedway)\b|ring\b"
TAIL = r"(?i)\s+(International Circuit|Motor Speedway|Park Circuit|Circuit|Autodrome|Autodromo|Raceway|Speedway|Ring)$"
HEAD = r"(?i)^(Circuit de|Autodromo(?: Internazionale)?|Autodrome)\s+(.+)$"
HEAD_WORD = r"(?i)^(Circuit de|Autodromo(?: Internazionale)?|Autodrome)\b"
GENERIC_LAYOUT = r"(?i)^(main|alternate|layout\s+\d+)$"
LAYOUT_ONLY = r"(?i)^(grand prix circuit|inner circuit|national circuit|main|alternate|layout\s+\d+)$"
VARIANT = r"(?i)\b(grand\s*prix|gp|layout|oval|national|endurance|inner|outer|short|alternate|club|kart|moto|rallycross|test|main)\b"
EVENT = r"(?i)\bgrand\s*prix\b|\bgp\b"
DESCRIPTION = r"(?i)\b(circuit|raceway|track)\b.*\b(in|on|near|at)\b.*,"
FEW_WORDS = r"(?i)^[a-z0-9'.-]+( [a-z0-9'.-]+){0,2}$"


def described(value: Column, description: Column) -> Column:
    """The value is the description itself or reads like one."""
    key = T.name_key(value)
    return (key != "") & ((key == T.name_key(description)) | T.collapse_space(value).rlike(DESCRIPTION))


def _flags(c: Column) -> Column:
    v, source = c["value"], c["source"]
    strong, event = v.rlike(STRONG), v.rlike(EVENT)
    generic = ~strong & v.rlike(FEW_WORDS)
    points = [(strong, 100), (v.rlike(HEAD_WORD), 20), (v.rlike(r"(?i)\bInternational Circuit\b"), 15), (source == "label", 6), (source == "osm", 3), (source == "shortName", -40), (event, -20), (generic, -10)]
    score = sum((F.when(test, n).otherwise(0) for test, n in points), F.lit(0))
    return F.struct(v.alias("value"), source.alias("source"), c["index"].alias("index"), T.name_key(v).alias("key"), strong.alias("strong"), event.alias("event"), v.rlike(LAYOUT_ONLY).alias("layout_only"), generic.alias("generic"), score.alias("score"))


def candidates(label: Column, aliases: Column, short_name: Column, seen_names: Column) -> Column:
    """All non-empty names with their source, place there, flags and score."""
    one = lambda c, s: F.array(F.struct(T.collapse_space(c).alias("value"), F.lit(s).alias("source"), F.lit(0).alias("index")))
    many = lambda a, s: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x, i: F.struct(T.collapse_space(x).alias("value"), F.lit(s).alias("source"), i.alias("index")))
    every = F.concat(one(label, "label"), many(aliases, "alias"), many(seen_names, "osm"), one(short_name, "shortName"))
    return F.transform(F.filter(every, lambda c: c["value"] != ""), _flags)


def best_of_keys(found: Column) -> Column:
    """Of the candidates with one key: the highest score, then the smallest place, then the first."""
    ahead = lambda x, y: (y["score"] > x["score"]) | ((y["score"] == x["score"]) & ((y["index"] < x["index"]) | ((y["index"] == x["index"]) & (F.array_position(found, y) < F.array_position(found, x)))))
    return F.array_distinct(F.filter(found, lambda x: ~F.exists(found, lambda y: (y["key"] == x["key"]) & ahead(x, y))))


def admissible(found: Column, description: Column) -> Column:
    """Without descriptions and bare layout names; event and generic names only where no proper venue name is."""
    proper = F.exists(found, lambda c: c["strong"] & ~c["event"] & ~c["layout_only"])
    return F.filter(found, lambda c: ~described(c["value"], description) & ~c["layout_only"] & ~((c["event"] | c["generic"]) & proper))


def layout_suffix(layout: Column, base: Column, kept: Column) -> Column:
    """The layout's name where it says more than the venue's; else null."""
    name = T.collapse_space(layout)
    a, b = T.name_key(base), T.name_key(name)
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    same_words = (F.size(wa) == F.size(wb)) & (F.size(F.array_except(wb, wa)) == 0)
    is_alias = F.exists(kept, lambda c: (c["value"] != base) & (c["value"] == name) & ~c["value"].rlike(VARIANT))
    none = (b == "") | name.rlike(GENERIC_LAYOUT) | a.contains(b) | b.contains(a) | same_words | is_alias
    return F.when(~none, name)


def compose(base: Column, suffix: Column) -> Column:
    """The venue's name, without its trailing or leading venue word, and the suffix."""
    root = T.collapse_space(F.regexp_replace(base, TAIL, ""))
    shorter = F.when(base.rlike(TAIL) & (root != ""), root).when(base.rlike(HEAD) & suffix.rlike(r"(?i)\bCircuit\b"), F.regexp_extract(base, HEAD, 2)).otherwise(base)
    return F.when(suffix.isNull(), base).otherwise(F.concat_ws(" ", shorter, suffix))


def printed_names(rows: DataFrame) -> DataFrame:
    """(label, aliases, short_name, description, seen_names, layout) -> and base_name, suffix, printed_name, reason.

    Nulls count as empty names; a row without any name is ``Unknown``.
    """
    rows = rows.withColumn("__all", candidates(F.col("label"), F.col("aliases"), F.col("short_name"), F.col("seen_names")))
    rows = rows.withColumn("__kept", admissible(best_of_keys(F.col("__all")), F.col("description")))
    order = F.transform("__kept", lambda c: F.struct((-c["score"]).alias("s"), F.length(c["value"]).alias("n"), c["source"].alias("source"), c["index"].alias("index"), c["value"].alias("value"), c["strong"].alias("strong")))
    rows = rows.withColumn("__best", F.get(F.array_sort(order), F.lit(0)))
    fallback = F.coalesce(*[F.when((T.collapse_space(F.col(c)) != "") & ~described(F.col(c), F.col("description")), T.collapse_space(F.col(c))) for c in ("short_name", "label")], F.lit("Unknown"))
    rows = rows.withColumn("base_name", F.coalesce("__best.value", fallback))
    rows = rows.withColumn("suffix", layout_suffix(F.col("layout"), F.col("base_name"), F.col("__kept")))
    own = F.exists("__kept", lambda c: (c["source"] == "label") & (c["value"] == T.collapse_space(F.col("label"))) & c["strong"] & ~c["value"].rlike(HEAD_WORD))
    source = F.col("__best.source")
    better = own & (source == "alias") & F.col("__best.strong") & F.col("__best.value").rlike(HEAD_WORD)
    reason = F.when(source.isNull(), "fell back to label because no valid candidate remained").when(better, "alias clearly improves label wording").when(source == "shortName", "short name fallback because no better venue-form candidate exists").otherwise(F.concat(F.lit("selected best "), source, F.lit(" venue candidate")))
    return rows.withColumn("printed_name", compose(F.col("base_name"), F.col("suffix"))).withColumn("reason", reason).drop("__all", "__kept", "__best")


def layout_label(name: Column, metres: Column, position: Column) -> Column:
    """``name - X.X km``; without a name ``Layout n``, counted from 1."""
    shown = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Layout "), (position + 1).cast("string")))
    return F.when(F.coalesce(metres, F.lit(0.0)) != 0, F.concat(shown, F.lit(" - "), F.format_string("%.1f", metres / 1000), F.lit(" km"))).otherwise(shown)
