"""Payloads of map and entity services as rows, and the addresses to ask for them.

Fetching is left to whoever fills the landing folder; what is read here are files, so that a lost task reads them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import merge_tags

_TEXT = "map<string, struct<value: string>>"
_CLAIM = "array<struct<mainsnak: struct<datavalue: struct<value: string>>>>"
#: Entities by id; a claim's value stays JSON, as its form depends on the property.
ENTITIES = f"entities map<string, struct<labels: {_TEXT}, aliases: map<string, array<struct<value: string>>>, descriptions: {_TEXT}, claims: map<string, {_CLAIM}>>>"
#: Properties of the short name, the country, and the places, in order of preference.
SHORT_NAME, COUNTRY, PLACES = "P1813", "P17", ("P740", "P276", "P131", "P159")
_POINTS = "array<struct<lat: double, lon: double>>"
ELEMENTS = f"elements array<struct<type: string, id: long, tags: map<string, string>, geometry: {_POINTS}, members: array<struct<type: string, ref: long, role: string, geometry: {_POINTS}>>>>"
#: Fixed value: members of this role are no part of a course.
LEFT_OUT = "pit_lane"


def _claims(key: str, path: str) -> Column:
    """Values of a property that are there, in order."""
    found = F.transform(F.try_element_at("e.claims", F.lit(key)), lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], path))
    return F.coalesce(F.filter(found, lambda v: v != ""), F.array().cast("array<string>"))


def entity_details(payloads: DataFrame, asked: DataFrame | None = None, language: str = "en") -> DataFrame:
    """(entities) of :data:`ENTITIES` -> (id, label, aliases, description, short_name, country_id, place_ids).

    With ``asked`` (id), a row for each of its ids, empty where no payload has it.
    """
    word = lambda c: F.try_element_at(c, F.lit(language))["value"]
    none = F.array().cast("array<string>")
    names = F.transform(F.try_element_at("e.aliases", F.lit(language)), lambda a: a["value"])
    rows = payloads.select(F.explode("entities").alias("id", "e")).select(
        "id", word("e.labels").alias("label"), F.coalesce(F.filter(names, lambda n: n != ""), none).alias("aliases"), word("e.descriptions").alias("description"),
        F.get(_claims(SHORT_NAME, "$.text"), F.lit(0)).alias("short_name"), F.get(_claims(COUNTRY, "$.id"), F.lit(0)).alias("country_id"), F.concat(*[_claims(p, "$.id") for p in PLACES]).alias("place_ids"),
    )
    if asked is None:
        return rows
    return asked.select("id").distinct().join(rows, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("aliases", "place_ids")})


def payload_ways(payloads: DataFrame) -> DataFrame:
    """(payload, elements) of :data:`ELEMENTS` -> (payload, id, tags, relation_names, nodes): a row for each way of two nodes or more.

    The first way of an id counts. Members of relations replace its nodes, the last one last; their relation's tags fill
    in what the way and relations before have not, and the relations' names are listed once each.
    """
    e = payloads.select("payload", F.posexplode("elements").alias("place", "e"))
    own = e.where("e.type = 'way'").select("payload", F.col("e.id").alias("id"), F.struct(F.lit(0).alias("kind"), (-F.col("place")).alias("place"), F.lit(0).alias("part")).alias("rank"), F.col("e.tags").alias("tags"), F.col("e.geometry").alias("nodes"))
    parts = e.where("e.type = 'relation'").select("payload", "place", F.col("e.tags").alias("tags"), F.posexplode("e.members").alias("part", "m"))
    parts = parts.where((F.col("m.type") == "way") & ~F.col("m.role").eqNullSafe(LEFT_OUT)).select("payload", F.col("m.ref").alias("id"), F.struct(F.lit(1).alias("kind"), F.col("place"), F.col("part")).alias("rank"), "tags", F.col("m.geometry").alias("nodes"))
    rows = own.unionByName(parts).where("id is not null and size(nodes) >= 2")
    item = F.struct("rank", "tags")
    # A way's own entries are ranked backwards, so that its first one is the greatest of them.
    per = rows.groupBy("payload", "id").agg(F.max_by("nodes", "rank").alias("nodes"), F.collect_list(item).alias("all"), F.max(F.when(F.col("rank.kind") == 0, F.col("rank.place"))).alias("own"))
    kind = "map<string,string>"
    mine = F.filter("all", lambda x: (x["rank"]["kind"] == 0) & (x["rank"]["place"] == F.col("own")))
    base = F.coalesce(F.get(mine, F.lit(0))["tags"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).cast(kind)
    order = F.transform(F.filter("all", lambda x: x["rank"]["kind"] == 1), lambda x: F.struct(x["rank"]["place"].alias("place"), x["rank"]["part"].alias("part"), F.map_entries(x["tags"]).alias("tags")))
    rels = F.transform(F.array_sort(order), lambda x: F.map_from_entries(x["tags"]))
    tags = F.aggregate(rels, base, lambda kept, r: merge_tags(r, kept).cast(kind))
    names = F.array_distinct(F.filter(F.transform(rels, lambda r: F.trim(F.try_element_at(r, F.lit("name")))), lambda n: n != ""))
    return per.select("payload", "id", tags.alias("tags"), names.alias("relation_names"), "nodes")


def first_of_ways(ways: DataFrame) -> DataFrame:
    """One row an ``id``, that of the smallest ``payload``."""
    w = Window.partitionBy("id").orderBy("payload")
    return ways.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def box_url(base: str, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Address of a map extract; an error where an edge is not finite or the box is empty."""
    sides = (south, west, north, east)
    finite = F.lit(True)
    for v in sides:
        finite = finite & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    url = F.concat(F.lit(f"{base}?bbox="), F.concat_ws(",", *[F.format_string("%s", v.cast("double")) for v in (west, south, east, north)]))
    return F.when(~finite, F.raise_error("bbox coordinates must be finite")).when((south >= north) | (west >= east), F.raise_error("bbox must have south < north and west < east")).otherwise(url)


def around_url(base: str, lat: Column, lon: Column, margin: Column) -> Column:
    """Address of the extract within ``margin`` degrees of a position."""
    ok = F.coalesce(~F.isnan(margin) & (margin > 0) & (margin < float("inf")), F.lit(False))
    return F.when(~ok, F.raise_error("bbox margin must be a positive number")).otherwise(box_url(base, lat - margin, lon - margin, lat + margin, lon + margin))


def way_url(base: str, way: Column) -> Column:
    return F.when(F.coalesce(way > 0, F.lit(False)), F.concat(F.lit(f"{base}/"), way.cast("string"), F.lit("/full"))).otherwise(F.raise_error("way id must be a positive finite number"))


def folder_scan(spark: SparkSession, folder: str, schema: str, asked: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of a folder's JSON files with their file's ``id``, asked ids that have no file)."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    files = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    rows = files.select(stem.alias("id"), *[c for c in files.columns if c != "id"])
    if asked is None:
        return rows, spark.createDataFrame([], "id string")
    ids = spark.createDataFrame([(i,) for i in asked], "id string").distinct()
    rows = rows.join(ids, "id", "left_semi")
    return rows, ids.join(rows.select("id"), "id", "left_anti")
