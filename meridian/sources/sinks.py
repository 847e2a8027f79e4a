"""Writers: documents by key, one sorted array, triangle files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: How a partition folder names a null key.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def write_documents(df: DataFrame, folder: str, key: str, force: bool = False, dry_run: bool = False) -> DataFrame:
    """Rows as JSON under one folder a key. Keys that are there stay unless ``force``; (written, skipped) rows return."""
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    names = [f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)] if there else []
    keys = [(unquote(n.split("=", 1)[1]),) for n in names if n.startswith(f"{key}=")]  # folder names only, no document is read
    known = spark.createDataFrame([(None if k == NO_KEY else k,) for (k,) in keys], "__key string")
    marked = df.withColumn("__key", F.col(key).cast("string")).join(known.withColumnRenamed("__key", "__is").withColumn("__old", F.lit(True)), F.col("__key").eqNullSafe(F.col("__is")), "left").drop("__is")
    new = marked if force else marked.where("__old is null")
    counts = marked.agg(F.count_if(F.lit(force) | F.col("__old").isNull()).alias("written"), F.count_if(~F.lit(force) & F.col("__old").isNotNull()).alias("skipped"))
    counts = spark.createDataFrame(counts.collect(), counts.schema)
    if not dry_run:
        out = new.drop("__key", "__old").write.partitionBy(key)
        if force:
            out.mode("overwrite").option("partitionOverwriteMode", "dynamic").json(folder)
        else:
            out.mode("append").json(folder)
    return counts


def sorted_array(df: DataFrame, *order: str) -> DataFrame:
    """(place, json): rows as JSON in order, for an index of one array; ranges are sorted, not one partition."""
    return df.orderBy(*order).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def file_name(name: Column, extension: str = ".3mf", nameless: str = "model") -> Column:
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9._-]+", "-"), "-+", "-"), "^-+|-+$", "")
    base = F.when(base == "", nameless).otherwise(base)
    return F.when(base.endswith(extension), base).otherwise(F.concat(base, F.lit(extension)))


RECORD = np.dtype([("v", "<f4", (4, 3)), ("spare", "<u2")])


def triangle_records(df: DataFrame, corners: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``record``: 50 bytes a triangle (normal, corners, spare). Triangles with equal corners on the 1e-4 grid go.

    ``corners``: nine columns ax .. cz. Records are made a batch at a time; files are their concatenation behind
    :func:`triangle_header`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = b[corners].to_numpy(float).reshape(-1, 3, 3)
            q = np.floor(v / 1e-4 + 0.5)
            same = (q == np.roll(q, 1, axis=1)).all(2).any(1)
            v, b = v[~same], b[~same]
            n = np.cross(v[:, 1] - v[:, 0], v[:, 2] - v[:, 0])
            size = np.linalg.norm(n, axis=1, keepdims=True)
            out = np.zeros(len(v), RECORD)
            out["v"][:, 0], out["v"][:, 1:] = n / np.where(size > 0, size, 1), v
            yield b[keep].assign(record=[r.tobytes() for r in out])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*dict.fromkeys(keep + corners)).mapInPandas(run, f"{kinds}, record binary")


def triangle_header(name: str, triangles: int) -> bytes:
    """84 bytes: the name in printable ASCII, and how many records follow."""
    return "".join(c if " " <= c <= "~" else " " for c in name)[:80].encode().ljust(80, b"\0") + struct.pack("<I", triangles)
