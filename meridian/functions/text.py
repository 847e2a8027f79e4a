"""Text functions of the lookup: normal forms, tokens, slugs, name keys, overlap measures."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Letters of Latin-1 that decompose into a letter and a mark, and those letters.
_PAIRS = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFKD", chr(c))) == 2 and unicodedata.combining(unicodedata.normalize("NFKD", chr(c))[1])]
ACCENTED, BARE = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)


def _ranges(codes: list[int]) -> str:
    """Character class of ascending code points."""
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))


#: Strings of these alone need no table beyond ``ACCENTED``: compatibility letters (ligatures, circled, wide) are not among them.
_SIMPLE = "^[" + _ranges([c for c in range(0x180) if chr(c) in ACCENTED or unicodedata.normalize("NFKD", chr(c)) == chr(c)] + list(range(0x300, 0x370))) + "]*$"


def _bare(text: str | None) -> str | None:
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text) if not 0x300 <= ord(c) <= 0x36F)


@F.pandas_udf(StringType())
def _decompose(values: pd.Series) -> pd.Series:
    return values.map(_bare)


@F.pandas_udf(ArrayType(StringType()))
def _decompose_each(values: pd.Series) -> pd.Series:
    return values.map(lambda names: None if names is None else [_bare(n) for n in names])


def strip_latin_marks(value: Column) -> Column:
    """Latin letters without their marks, in the JVM (also within lambdas)."""
    return F.regexp_replace(F.translate(value, ACCENTED, BARE), "[̀-ͯ]", "")


def strip_marks(value: Column) -> Column:
    """Compatibility decomposition without combining marks. Strings of plain Latin letters stay in the JVM; Arrow gets the others."""
    simple = F.coalesce(value.rlike(_SIMPLE), F.lit(True))
    return F.when(simple, strip_latin_marks(value)).otherwise(_decompose(F.when(~simple, value)))


def strip_marks_each(values: Column) -> Column:
    """``strip_marks`` of an array's strings."""
    simple = F.coalesce(F.forall(values, lambda v: F.coalesce(v.rlike(_SIMPLE), F.lit(True))), F.lit(True))
    return F.when(simple, F.transform(values, strip_latin_marks)).otherwise(_decompose_each(F.when(~simple, values)))


def collapse_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))


def plain_text(bare: Column) -> Column:
    """A text without marks in lower case, ``&`` spelt out, other signs as single spaces."""
    plain = F.replace(F.lower(F.coalesce(bare, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def search_text(value: Column) -> Column:
    """Normal form for lookups."""
    return plain_text(strip_marks(value))


def search_texts(values: Column) -> Column:
    """Normal forms of an array's strings, those that are empty left out, each once."""
    return F.array_distinct(F.filter(F.transform(strip_marks_each(values), plain_text), lambda n: n != ""))


def tokens_of(normal: Column) -> Column:
    """Distinct tokens of a normalised text, in order."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))


def name_key(value: Column) -> Column:
    """Lower-case letters and digits, all else single spaces; marks are not folded."""
    return F.trim(F.regexp_replace(F.lower(collapse_space(value)), "[^a-z0-9]+", " "))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_marks(F.coalesce(value, F.lit("")))), "[^a-z0-9]+", "-"), "^-|-$", "")


def last_segment(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def display_name(label: Column, city: Column, country: Column, n_city: Column | None = None, n_country: Column | None = None) -> Column:
    """``label - city, country``; places that are missing, or alike in their normal forms, appear once or not at all."""
    n_city, n_country = (search_text(x) if n is None else n for x, n in ((city, n_city), (country, n_country)))
    none = lambda c: F.when(c != "", c)
    place = F.concat_ws(", ", none(city), F.when(F.coalesce((n_city != n_country) | (city == ""), F.lit(True)), none(country)))
    return F.concat_ws(" - ", none(label), none(place))


def overlap(query: Column, tokens: Column) -> tuple[Column, Column, Column]:
    """(matched, covers all, share of the candidate); matched is 0 where either side is empty."""
    matched = F.size(F.array_intersect(query, tokens))
    return matched, (F.size(query) > 0) & (matched == F.size(query)), matched / F.greatest(F.size(F.array_distinct(tokens)), F.lit(1))


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def retry_delay_seconds(body: Column) -> Column:
    """Seconds of a ``wait n seconds|minutes|hours`` text; null if there is none."""
    pattern = r"(?i)wait\s+(\d+)\s*(second|minute|hour)"
    unit = F.lower(F.regexp_extract(body, pattern, 2))
    scale = F.when(unit == "hour", 3600).when(unit == "minute", 60).when(unit == "second", 1)
    return F.when(unit != "", F.regexp_extract(body, pattern, 1).cast("long")) * scale
