"""Queries of the lookup over suppliers as venues (STR01-11, SET01-02, PRJ13, FLT01, SRT01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search

ASKED = ("supplier", "africa", "nation 3", "supplier 000000004", "asia nation", "upplier#0000", "Nation_1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("venue_id"), F.col("s_name").alias("label"), F.array(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("aliases"), F.lit(None).cast("string").alias("short_name"), F.col("n_name").alias("city"), F.col("r_name").alias("country"), F.lit("venue").alias("type"), F.lit(0.0).alias("lat"), F.col("s_acctbal").alias("lon"))


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = search.build_index(venues(spark, sf_dir))
    return i.select("venue_id", "name", "n_label", F.concat_ws("|", "phrases").alias("phrases"), F.concat_ws("|", F.array_sort("tokens")).alias("tokens"), "token_count", "alias_count", "label_words")


def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(q,) for q in ASKED], "query string")
    return search.rank(search.build_index(venues(spark, sf_dir)), asked).orderBy("query", F.desc("rank_score"), F.length("name"), "name")


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = T.search_text(F.col("text"))
    return d.select("doc_id", F.md5(n).alias("normal"), F.size(T.tokens_of(n)).alias("tokens"), F.md5(T.name_key(F.col("text"))).alias("key"), F.md5(T.slug(F.col("text"))).alias("slug"))


def last_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.last_segment(F.col("url")).alias("segment"))


QUERIES = {"search_index": search_index, "search_rank": search_rank, "text_forms": text_forms, "last_segments": last_segments}

NORMAL = "trim(regexp_replace(replace(lower(strip_accents({0})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
INDEX_SQL = f"""
SELECT s_suppkey AS venue_id, s_name AS label, n_name AS city, r_name AS country, 'S' || s_suppkey AS alias,
  {NORMAL.format("s_name")} AS n_label, {NORMAL.format("'S' || s_suppkey")} AS n_alias, {NORMAL.format("n_name")} AS n_city, {NORMAL.format("r_name")} AS n_country,
  s_name || ' - ' || n_name || ', ' || r_name AS name
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
PHRASED = f"""base AS ({INDEX_SQL}), idx AS (
  SELECT *, [n_label, n_alias, n_city, n_country] AS phrases, list_distinct(flatten([string_split(n_label, ' '), string_split(n_alias, ' '), string_split(n_city, ' '), string_split(n_country, ' ')])) AS tokens FROM base)"""
ORACLES = {
    "search_index": f"""WITH {PHRASED} SELECT venue_id, name, n_label, array_to_string(phrases, '|') AS phrases, array_to_string(list_sort(tokens), '|') AS tokens,
  CAST(len(tokens) AS INTEGER) AS token_count, 1 AS alias_count, CAST(len(list_distinct(string_split(label, ' '))) AS INTEGER) AS label_words FROM idx""",
    "search_rank": f"""WITH {PHRASED}, asked AS (
  SELECT query, {NORMAL.format("query")} AS q, list_distinct(string_split({NORMAL.format("query")}, ' ')) AS qt FROM (VALUES {", ".join(f"('{q}')" for q in ASKED)}) t(query)
), m AS (
  SELECT *, len(list_intersect(qt, tokens)) AS k, len(list_intersect(qt, string_split(n_label, ' '))) AS kl, len(list_intersect(qt, string_split(n_alias, ' '))) AS ka,
    len(list_intersect(qt, list_concat(string_split(n_city, ' '), string_split(n_country, ' ')))) AS kp FROM idx, asked
), c AS (
  SELECT *, CASE WHEN n_label = q THEN 'exact-label' WHEN n_alias = q THEN 'exact-alias' WHEN n_city = q THEN 'exact-city' WHEN list_contains(phrases, q) THEN 'exact-phrase'
    WHEN starts_with(n_label, q) THEN 'prefix-label' WHEN starts_with(n_alias, q) THEN 'prefix-alias' WHEN len(list_filter(phrases, lambda p: starts_with(p, q))) > 0 THEN 'prefix-phrase'
    WHEN k > 0 THEN 'token-overlap' WHEN len(list_filter(phrases, lambda p: contains(p, q) OR contains(q, p))) > 0 THEN 'substring' END AS match_category FROM m
)
SELECT query, venue_id, name, match_category, CAST(CASE match_category WHEN 'exact-label' THEN 5000 WHEN 'exact-alias' THEN 4700 WHEN 'exact-city' THEN 4300 WHEN 'exact-phrase' THEN 4000
    WHEN 'prefix-label' THEN 3600 WHEN 'prefix-alias' THEN 3350 WHEN 'prefix-phrase' THEN 3100 WHEN 'substring' THEN 900
    ELSE (CASE WHEN k = len(qt) THEN 2500 ELSE 1800 END) + k * 140 + floor(k / len(qt) * 200 + 0.5) + floor(k / len(tokens) * 80 + 0.5) END
  + CASE WHEN kl = len(qt) THEN 280 ELSE 0 END + CASE WHEN ka = len(qt) THEN 180 ELSE 0 END + CASE WHEN kp = len(qt) THEN 80 ELSE 0 END
  - CASE WHEN match_category IN ('exact-city', 'exact-phrase') AND kl + ka = 0 THEN 120 ELSE 0 END
  - CASE WHEN regexp_matches(label, '\\b\\d{{4}}\\b') THEN 260 ELSE 0 END AS BIGINT) AS rank_score
FROM c WHERE match_category IS NOT NULL""",
    "text_forms": f"""SELECT doc_id, md5(n) AS normal, CAST(len(list_distinct(list_filter(string_split(n, ' '), lambda t: t <> ''))) AS INTEGER) AS tokens,
  md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS key, md5(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug
FROM (SELECT doc_id, coalesce(text, '') AS text, {NORMAL.format("coalesce(text, '')")} AS n FROM documents)""",
    "last_segments": "SELECT page_id, string_split(url, '/')[-1] AS segment FROM pages",
}
