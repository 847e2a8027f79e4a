"""Streaming forms of the chain operators: running measures of positions by time window, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_measures(points: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(chain, time, lat, lon) -> points, bounds and mean position of each chain and window; rows later than ``late`` go."""
    g = points.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "chain")
    m = g.agg(F.count("*").alias("points"), F.min("lat").alias("lat1"), F.max("lat").alias("lat2"), F.min("lon").alias("lon1"), F.max("lon").alias("lon2"), F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    return m.select("chain", F.col("w.start").alias("start"), "points", "lat1", "lat2", "lon1", "lon2", "mean_lat", "mean_lon")


def first_of_keys(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once while the watermark has not passed it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def read_events(spark, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
