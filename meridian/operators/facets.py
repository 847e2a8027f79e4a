"""Facet census and facet filters over tag maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = "UNTAGGED"


def census(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n) of each facet column, missing values as their own; one pass, partial counts."""
    pair = lambda k: F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit(NONE)).alias("value"))
    return rows.select(F.explode(F.array(*map(pair, keys))).alias("f")).groupBy("f.key", "f.value").agg(F.count("*").alias("n"))


def filterable(counts: DataFrame, least: int = 3) -> DataFrame:
    """Facets worth a filter: at least ``least`` rows tagged and two values."""
    g = counts.where(F.col("value") != NONE).groupBy("key").agg(F.sum("n").alias("tagged"), F.count("*").alias("values"))
    return g.where((F.col("tagged") >= least) & (F.col("values") >= 2))


def apply_filters(rows: DataFrame, unchecked: dict[str, list[str]]) -> DataFrame:
    """Rows none of whose facet values is unchecked."""
    for key, values in unchecked.items():
        rows = rows.where(~F.coalesce(F.col(key).cast("string"), F.lit(NONE)).isin(values))
    return rows
