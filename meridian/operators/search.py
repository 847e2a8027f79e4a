"""Lookup index and ranked lookup of venues by name, alias, short name and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words of venues and of layouts, and what an identifier looks like.
VENUE = r"(?iu)\b(international circuit|circuit|autodrome|autodromo|raceway|speedway|ring)\b"
VARIANT = r"(?iu)\b(layout|variant|alternate|alternative|historic|historical|original|modified|grand\s+prix|gp\b|national|club|endurance|inner|outer|short|oval|\d{4})\b"
RAW_ID = r"(?i)^q\d+$"
#: Letters of the pieces by which texts that hold one another meet.
GRAM = 3
#: Scores of the match categories.
SCORES = {"exact-label": 5000, "exact-alias": 4700, "exact-short-name": 4550, "exact-city": 4300, "exact-phrase": 4000, "prefix-label": 3600, "prefix-alias": 3350, "prefix-short-name": 3825, "prefix-phrase": 3100, "substring": 900}


def build_index(venues: DataFrame) -> DataFrame:
    """(venue_id, label, aliases, short_name, city, country, type, lat, lon) -> with normal forms, phrases, tokens, counts.

    A label that is empty or a raw identifier gives way to the first alias that is neither. Rows without a normal form of
    either, without a finite position, or named by raw identifiers only are left out.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    aliases = F.array_distinct(F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), T.collapse_space), lambda a: a != ""))
    rows = venues.where(finite(F.col("lat")) & finite(F.col("lon"))).withColumns({"aliases": aliases, "given": T.collapse_space(F.col("label")), **{c: T.collapse_space(F.col(c)) for c in ("short_name", "city", "country")}})
    useful = lambda n: (n != "") & ~n.rlike(RAW_ID)
    rows = rows.withColumn("label", F.when(useful(F.col("given")), F.col("given")).otherwise(F.coalesce(F.get(F.filter("aliases", useful), F.lit(0)), F.col("given"))))
    rows = rows.withColumns({"n_label": T.search_text(F.col("label")), "n_aliases": T.search_texts(F.col("aliases")), "n_short": T.search_text(F.col("short_name")), "n_city": T.search_text(F.col("city")), "n_country": T.search_text(F.col("country"))})
    named = (F.col("n_label") != "") | (F.size("n_aliases") > 0)
    rows = rows.where(named & (useful(F.col("given")) | F.exists("n_aliases", useful)))
    phrases = F.array_distinct(F.filter(F.flatten(F.array(F.array("n_label"), "n_aliases", F.array("n_short", "n_city", "n_country"))), lambda p: p != ""))
    rows = rows.withColumn("phrases", phrases).withColumn("tokens", F.array_distinct(F.flatten(F.transform("phrases", T.tokens_of))))
    name = T.display_name(F.col("label"), F.col("city"), F.col("country"), F.col("n_city"), F.col("n_country"))
    return rows.withColumns({"token_count": F.size("tokens"), "alias_count": F.size("aliases"), "label_words": F.size(T.tokens_of(F.col("given"))), "name": name}).drop("given")


def _grams(value: Column) -> Column:
    """Strings of up to ``GRAM`` letters that a text holds."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - n + 1, F.lit(1))), lambda i: F.substring(value, i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*[at(n) for n in range(1, GRAM + 1)])))


def candidates(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, venue_id): pairs that share a token, or of which one may hold the other: the begin of the one is a piece of the other.

    Three equi-joins; which pairs match, and how, is decided on these alone.
    """
    phrases = index.select("venue_id", F.explode("phrases").alias("phrase"))
    begin = lambda c: F.substring(c, 1, GRAM)
    by_token = index.select("venue_id", F.explode("tokens").alias("key")).join(asked.select("q", F.explode("qt").alias("key")), "key")
    held = phrases.select("venue_id", F.explode(_grams(F.col("phrase"))).alias("key")).distinct().join(asked.select("q", begin("q").alias("key")), "key")
    holds = phrases.select("venue_id", begin("phrase").alias("key")).distinct().join(asked.select("q", F.explode(_grams(F.col("q"))).alias("key")), "key")
    pairs = [x.select("q", "venue_id") for x in (by_token, held, holds)]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()


def rank(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query) and index -> (query, venue_id, name, rank_score, match_category), only what matches."""
    asked = queries.select("query", T.search_text(F.col("query")).alias("q")).where("q <> ''").withColumn("qt", T.tokens_of(F.col("q")))
    pairs = candidates(index, asked.select("q", "qt").distinct())
    rows = pairs.join(index, "venue_id").join(asked, "q")
    q, qt = F.col("q"), F.col("qt")
    matched, covers, share = T.overlap(qt, F.col("tokens"))
    by_tokens = F.when(covers, 2500).otherwise(1800) + matched * 140 + T.half_up(matched / F.size(qt) * 200) + T.half_up(share * 80)
    either = lambda v: (v != "") & (v.contains(q) | F.contains(q, v))
    tests = [
        ("exact-label", F.col("n_label") == q), ("exact-alias", F.array_contains("n_aliases", q)), ("exact-short-name", F.col("n_short") == q),
        ("exact-city", F.col("n_city") == q), ("exact-phrase", F.array_contains("phrases", q)), ("prefix-label", F.col("n_label").startswith(q)),
        ("prefix-alias", F.exists("n_aliases", lambda a: a.startswith(q))), ("prefix-short-name", F.col("n_short").startswith(q)),
        ("prefix-phrase", F.exists("phrases", lambda p: p.startswith(q))), ("token-overlap", matched > 0),
        ("substring", either(F.col("n_label")) | F.exists("n_aliases", either) | F.exists("phrases", either)),
    ]
    category, base = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, test in reversed(tests):
        category = F.when(test, name).otherwise(category)
        base = F.when(test, by_tokens if name == "token-overlap" else F.lit(SCORES[name])).otherwise(base)
    rows = rows.withColumn("match_category", category).withColumn("base", base).where("match_category is not null")
    on = {n: T.overlap(qt, t)[:2] for n, t in {"label": T.tokens_of(F.col("n_label")), "alias": F.flatten(F.transform("n_aliases", lambda a: T.tokens_of(a))), "short": T.tokens_of(F.col("n_short")), "place": F.concat(T.tokens_of(F.col("n_city")), T.tokens_of(F.col("n_country")))}.items()}
    give = lambda test, points: F.when(test, points).otherwise(0)
    venue, exact_city = F.col("label").rlike(VENUE), F.col("match_category") == "exact-city"
    score = F.col("base") + give(on["label"][1], 280) + give(on["alias"][1], 180) + give(on["short"][1], 240) + give(on["place"][1], 80)
    score = score - give((exact_city | (F.col("match_category") == "exact-phrase")) & (on["label"][0] + on["alias"][0] == 0), 120)
    score = score + give(venue, 120) - give(F.col("label").rlike(VARIANT), 260) + give(F.coalesce(F.col("type") == "street circuit", F.lit(False)), 60)
    score = score - give(exact_city & on["label"][1] & ~venue, 420)
    score = score - F.greatest(F.lit(0), F.col("label_words") - 4) * 12 - F.greatest(F.lit(0), F.col("alias_count") - 4) * 6
    return rows.select("query", "venue_id", "name", score.cast("long").alias("rank_score"), "match_category")
