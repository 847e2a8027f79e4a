"""Ways and relations from map XML, and documents of one record a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: An attribute, and the entities in the order they are decoded.
ATTRIBUTE = r'([A-Za-z_:][-A-Za-z0-9_:.]*)="([^"]*)"'
ENTITIES = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
TRACK = "track_id string, name string, layouts array<struct<name string, nodes array<struct<lat double, lon double>>, stats struct<lengthMetres double>>>"


def decode_entities(value: Column) -> Column:
    value = F.coalesce(value, F.lit(""))
    for name, sign in ENTITIES:
        value = F.replace(value, F.lit(name), F.lit(sign))
    return value


def attributes(tag: Column) -> Column:
    """Attributes of a tag as a map; of a repeated name the last one counts."""
    keys = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1))
    values = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)), decode_entities)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"]))
    return F.map_from_entries(last)


def elements(xml: DataFrame, kind: str) -> DataFrame:
    """(file, text) -> (file, pos, attrs, body) of every ``kind`` element; a self-closing one has an empty body."""
    whole = rf"(?s)<{kind}\b((?:[^>\"]|\"[^\"]*\")*?)(?:/>|>(.*?)</{kind}>)"
    found = xml.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(whole), F.lit(0))).alias("pos", "raw"))
    return found.select("file", "pos", attributes(F.regexp_extract("raw", whole, 1)).alias("attrs"), F.regexp_extract("raw", whole, 2).alias("body"))


def _inner(body: Column, kind: str) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(rf"<{kind}\b((?:[^>\"]|\"[^\"]*\")*?)/?>"), F.lit(1)), attributes)


def tags(body: Column) -> Column:
    """Tags of an element: of a repeated key the last one counts."""
    t = F.filter(_inner(body, "tag"), lambda a: a["k"].isNotNull())
    last = F.filter(t, lambda a, i: ~F.exists(F.slice(t, i + 2, F.size(t)), lambda b: b["k"] == a["k"]))
    return F.map_from_entries(F.transform(last, lambda a: F.struct(a["k"], F.coalesce(a["v"], F.lit("")))))


def nodes(xml: DataFrame) -> DataFrame:
    n = elements(xml, "node").select("file", F.col("attrs")["id"].cast("long").alias("id"), F.col("attrs")["lat"].try_cast("double").alias("lat"), F.col("attrs")["lon"].try_cast("double").alias("lon"), "pos")
    return n.where("id is not null and lat is not null and lon is not null").groupBy("file", "id").agg(F.max_by(F.struct("lat", "lon"), "pos").alias("at"))


def ways(xml: DataFrame) -> DataFrame:
    """(file, pos, id, tags, geometry): ways of two or more nodes whose position is known, in their order."""
    w = elements(xml, "way").select("file", "pos", F.col("attrs")["id"].cast("long").alias("id"), tags(F.col("body")).alias("tags"), F.transform(_inner(F.col("body"), "nd"), lambda a: a["ref"].cast("long")).alias("refs"))
    at = w.select("file", "pos", F.posexplode("refs").alias("i", "ref")).join(nodes(xml).withColumnRenamed("id", "ref"), ["file", "ref"])
    line = at.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("line"))
    return w.join(line.where("size(line) >= 2"), ["file", "pos"]).select("file", "pos", "id", "tags", F.transform("line", lambda x: x["at"]).alias("geometry"))


def relations(xml: DataFrame) -> DataFrame:
    """(file, pos, id, tags, members): members in order, each with its way's geometry, null where the way is not there."""
    r = elements(xml, "relation").select("file", "pos", F.col("attrs")["id"].cast("long").alias("id"), tags(F.col("body")).alias("tags"), _inner(F.col("body"), "member").alias("m"))
    m = r.select("file", "pos", F.posexplode("m").alias("i", "a")).select("file", "pos", "i", F.col("a")["type"].alias("type"), F.col("a")["ref"].cast("long").alias("ref"), F.coalesce(F.col("a")["role"], F.lit("")).alias("role"))
    shape = ways(xml).select("file", F.lit("way").alias("type"), F.col("id").alias("ref"), "geometry", F.row_number().over(Window.partitionBy("file", "id").orderBy("pos")).alias("k")).where("k = 1").drop("k")
    full = m.join(shape, ["file", "type", "ref"], "left").groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "type", "ref", "role", "geometry"))).alias("members"))
    empty = F.array().cast(full.schema["members"].dataType)
    return r.drop("m").join(full, ["file", "pos"], "left").withColumn("members", F.coalesce("members", empty))


def documents(spark: SparkSession, folder: str, schema: str = TRACK) -> DataFrame:
    """One JSON document a file; records that do not parse are left out."""
    d = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    return d


def buildable(tracks: DataFrame) -> DataFrame:
    return tracks.where(F.exists("layouts", lambda x: F.size(x["nodes"]) >= 3))


def lookup(index: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows of the asked keys, ``found`` false where there is none; ``asked`` has (place, key) and keeps its places."""
    return asked.join(index.withColumn("__hit", F.lit(True)), key, "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit")
