"""Geometry documents, their choice of a layout, and the names and tags that circuits are told by: row-wise columns and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Fixed value: words of a layout's name.
LAYOUT = r"(?iu)\b(circuit|course|layout|oval|grand[\s_-]*prix|indy|national|endurance|inner|outer|short|chicane|bypass|long[\s_-]*lap|rallycross|moto[\s_-]*gp|alternate)\b"
#: What a picker says.
ONE_SECTION, FORKS = "Select the alternate section to use for the circuit.", "Select one of %d fork-based layout combinations."
_LAYOUTS = "array<struct<id:string,name:string,nodes:array<struct<lat:double,lon:double>>,stats:struct<lengthMetres:double,segmentCount:int,variantSectionCount:int>>>"


def whole_documents(docs: DataFrame) -> DataFrame:
    """(track_id, name, names struct<osmVenueNames>, layouts) with nothing missing: no layouts, nodes or names is an empty array, a layout without stats has zeros; ``selected`` is 0."""
    zero = F.struct(F.lit(0.0).alias("lengthMetres"), F.lit(0).alias("segmentCount"), F.lit(0).alias("variantSectionCount"))
    nodes = lambda x: F.coalesce(F.transform(x["nodes"], lambda n: F.struct(n["lat"].alias("lat"), n["lon"].alias("lon"))), F.array().cast("array<struct<lat:double,lon:double>>"))
    layouts = F.transform("layouts", lambda x: x.withField("nodes", nodes(x)).withField("stats", F.coalesce(x["stats"], zero)))
    return docs.withColumns({"layouts": F.coalesce(layouts, F.array().cast(_LAYOUTS)), "venue_names": F.coalesce(F.col("names.osmVenueNames"), F.array().cast("array<string>")), "selected": F.lit(0)})


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def index_positions(entries: DataFrame) -> DataFrame:
    """Entries of the index with a finite position: id, label, lat, lon."""
    return entries.where(finite(F.col("lat")) & finite(F.col("lon"))).select("wikidataId", "label", "lat", "lon")


def geometry_or_error(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(track_id, name) left join documents: ``error`` where there is none. Documents have each track once."""
    hit = asked.join(docs.select("track_id", "layouts"), "track_id", "left")
    return hit.withColumn("error", F.when(F.col("layouts").isNull(), F.concat(F.lit("No geometry for "), F.coalesce("name", F.col("track_id").cast("string"), F.lit("null")))))


def clamp_index(count: Column, index: Column) -> Column:
    """A place in ``count`` items: the nearest there is, 0 for what is no whole number or where there are none."""
    whole = F.when(finite(index) & (index == F.floor(index)), index).otherwise(0.0)
    return F.greatest(F.least(whole, (F.coalesce(count, F.lit(0)) - 1).cast("double")), F.lit(0.0)).cast("int")


def option_label(name: Column, metres: Column, place: Column) -> Column:
    named = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Layout "), (place + 1).cast("string")))
    return F.when(F.coalesce(metres, F.lit(0.0)) != 0, F.concat(named, F.format_string(" - %.1f km", metres / 1000))).otherwise(named)


def picker(tracks: DataFrame) -> DataFrame:
    """(track, layouts array<struct<name, metres, variants>>, index) -> hidden, hint, selected, options array<struct<value, label, selected>>."""
    n = F.coalesce(F.size("layouts"), F.lit(0))
    n, at = F.greatest(n, F.lit(0)), clamp_index(n, F.col("index").cast("double"))
    many = n > 1
    hint = F.when(~many, "").when(F.coalesce(F.get("layouts", F.lit(0))["variants"], F.lit(1)) == 1, ONE_SECTION).otherwise(F.format_string(FORKS, n))
    option = F.transform("layouts", lambda x, i: F.struct(i.cast("string").alias("value"), option_label(x["name"], x["metres"], i).alias("label"), (i == at).alias("selected")))
    none = F.array().cast("array<struct<value:string,label:string,selected:boolean>>")
    return tracks.withColumns({"hidden": ~many, "hint": hint, "selected": at, "options": F.when(many, option).otherwise(none)})


def layout_like(name: Column) -> Column:
    return F.coalesce(F.regexp_like(name, F.lit(LAYOUT)), F.lit(False))


def way_names(own: Column, relations: Column) -> Column:
    """array<struct<name, source>>: the way's own name, then its relations', trimmed, each once."""
    entry = lambda n, source: F.struct(F.trim(n).alias("name"), F.lit(source).alias("source"))
    every = F.concat(F.array(entry(own, "way")), F.transform(F.coalesce(relations, F.array().cast("array<string>")), lambda r: entry(r, "relation")))
    every = F.filter(every, lambda e: F.coalesce(e["name"] != "", F.lit(False)))
    return F.filter(every, lambda e, i: ~F.exists(F.slice(every, F.lit(1), i), lambda p: p["name"] == e["name"]))


def name_groups(ways: DataFrame) -> DataFrame:
    """(track, way_id, entries) -> (track, name, ways, rank): ways by each layout-like name, of tracks that have two such names."""
    each = ways.select("track", "way_id", F.explode("entries").alias("e")).where(layout_like(F.col("e.name")))
    groups = each.groupBy("track", F.col("e.name").alias("name")).agg(F.array_sort(F.collect_list("way_id")).alias("ways"), F.max((F.col("e.source") == "way").cast("int")).alias("rank"))
    two = groups.groupBy("track").agg(F.count("*").alias("n")).where("n >= 2").select("track")
    return groups.join(two, "track", "left_semi")


def length_target(label: Column, hints: Column) -> Column:
    """Metres of the first of array<struct<pattern, metres>> whose pattern the label's key has; null if none."""
    key = text.name_key(label)
    return F.get(F.filter(hints, lambda h: F.regexp_like(key, F.concat(F.lit("(?i)"), h["pattern"]))), F.lit(0))["metres"]


def circuit_relations(relations: DataFrame, wikidata: Column) -> DataFrame:
    """Relations (tags map) that are circuits of this id."""
    return relations.where((F.try_element_at("tags", F.lit("type")) == "circuit") & (F.try_element_at("tags", F.lit("wikidata")) == wikidata))


def circuit_ways(ways: DataFrame, members: DataFrame) -> DataFrame:
    """Ways (way_id, highway, sport) that are motor raceways or members (way_id) of a relation: ``by_relation_only``."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    hit = ways.join(members.select("way_id").distinct().withColumn("__member", F.lit(True)), "way_id", "left")
    tagged = (plain("highway") == "raceway") & (plain("sport") == "motor")
    member = F.coalesce("__member", F.lit(False))
    return hit.where(tagged | member).withColumn("by_relation_only", member & ~tagged).drop("__member")


def first_ways(parts: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, place, way_id, ...) -> each way as the first part has it; and the members (way_id) that no part has."""
    rest = [c for c in parts.columns if c != "way_id"]
    first = parts.groupBy("way_id").agg(F.min_by(F.struct(*rest), F.struct("part", "place")).alias("row")).select("way_id", "row.*")
    return first, members.select("way_id").distinct().join(first, "way_id", "left_anti")


def of_values(rows: DataFrame, key: str, values: list) -> DataFrame:
    """Rows whose key is one of a listed set, each once."""
    listed = rows.sparkSession.createDataFrame([(v,) for v in values], f"`{key}` {rows.schema[key].dataType.simpleString()}").distinct()
    return rows.join(F.broadcast(listed), key, "left_semi").distinct()  # a list in the call


def still_valid(cached: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Cached rows (key, generation, ...) whose generation is the current one (key, generation)."""
    return cached.join(versions.select(key, "generation"), [key, "generation"], "left_semi")


def export_document(rows: DataFrame) -> DataFrame:
    """(track_id, name, layouts array<struct<name, ways array<struct<wayId, fromNode, toNode>>>>, excluded array) -> and ``document``, its JSON.

    A nameless layout is ``Untitled``, the last of a name counts; anchors and exclusions that are not there are left out.
    """
    named = F.transform("layouts", lambda x: F.struct(F.coalesce(F.nullif(F.trim(x["name"]), F.lit("")), F.lit("Untitled")).alias("name"), F.struct(x["ways"].alias("ways")).alias("layout")))
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["name"] == x["name"]))
    excluded = F.when(F.size("excluded") > 0, F.col("excluded"))
    return rows.withColumn("document", F.to_json(F.struct(F.col("track_id").alias("trackId"), "name", F.map_from_entries(last).alias("layouts"), excluded.alias("excludedWays"))))
