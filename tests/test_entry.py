"""The registry's queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from meridian import registry

DATA = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x is None or x != x else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(c.sql(registry.oracle_sql()[name]).df())


def test_core_does_not_need_the_training_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/meridian/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "llm" not in open(path).read(), path
