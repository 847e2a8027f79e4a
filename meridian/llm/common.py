"""Shared plumbing of the training-data operators: checkpoint folder, scratch tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` where the session has it.

    Only where that setting is absent and the master is local (tests, notebooks) a temporary folder is made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="meridian-")
        sc.setCheckpointDir(named)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows are in the shared folder, lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a compressed scratch table into the shared folder and read it back (for wide or text rows)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``scratch``, and how many rows it has, counted while they are written."""
    seen = Observation()
    out = scratch(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def bucketed(df: DataFrame, keys: list[str], name: str, last: Callable) -> DataFrame:
    """Write ``df``, dealt by ``keys``, as a bucketed scratch table, so that joins on them leave it where it is.

    ``last`` goes over each dealt partition before it is written.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = parts(spark)
    dealt = df.repartition(n, *keys).mapInArrow(last, df.schema)
    dealt.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark).rstrip('/')}/{table}").bucketBy(n, *keys).saveAsTable(table)
    return spark.table(table)


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """``left`` inner join ``right`` on ``keys``; ``right`` has one row a key, with the number of its rows in ``left``.

    Keys that hold over one in ``share`` of the ``total`` rows, so fewer than ``share``, are broadcast and their rows stay
    where they are; the others are dealt by key.
    """
    heavy = right.where(F.col(weight) * share > total)
    light = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(right.where(F.col(weight) * share <= total), keys)
    return left.join(F.broadcast(heavy), keys).unionByName(light)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with sums over all rows before a row in a total order: sorted by ranges, summed within each, and the ranges' totals added.

    No task holds more than a range; of the ranges only one row each is gathered.
    """
    dealt = cut(df.repartitionByRange(parts(df.sparkSession), *order).withColumn("range_", F.spark_partition_id()))
    every = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range_").agg(*[F.sum(c).alias(f"all_{n}") for n, c in sums.items()])
    ahead = totals.select("range_", *[F.coalesce(F.sum(f"all_{n}").over(every), F.lit(0)).alias(f"ahead_{n}") for n in sums])
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(F.broadcast(ahead), "range_")  # one row a range
    return rows.withColumns({n: F.col(f"ahead_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).drop("range_", *[f"ahead_{n}" for n in sums])


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that none of their names can meet an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_key(df: DataFrame) -> Column:
    """128 bits of all columns (those with maps inside as JSON): struct(a, b)."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b"))


def repeated(df: DataFrame, times: str, name: str, most: int = 4096) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``name``; rows with more than ``most`` are dealt in pieces first."""
    few = df.where(F.col(times) <= most).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times).cast("long") - 1)))
    many = df.where(F.col(times) > most).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{times}` - 1) div {most}"))))
    many = many.repartition(parts(df.sparkSession), F.xxhash64(name, times))
    many = many.withColumn(name, F.explode(F.sequence(F.col(name) * most, F.least((F.col(name) + 1) * most, F.col(times).cast("long")) - 1)))
    return few.unionByName(many)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src long, dst long) -> (node, root): root is the smallest node of the component.

    Alternating large-star and small-star rounds. Each star takes its minimum with a partial aggregate and gives it
    back by an equi-join, so a hub's neighbours are never collected; rounds end in a checkpoint.
    Nodes without an edge are not listed; null ends are ignored.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    pairs = cut(pairs.where("u > v").distinct())
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = cut(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
