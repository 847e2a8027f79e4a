"""Where an iterative operator keeps its rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names; one is made only where none is named and the master is local, as in tests."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="meridian-"))
    return df.checkpoint(eager=True)
