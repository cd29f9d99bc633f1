"""Every registered query with SQL gives the same rows as its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from textquarry.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "-" if v != v else round(v, 5) + 0.0
    return "-" if v is None or v is pd.NaT else str(v).replace("+00:00", "") if hasattr(v, "year") else v


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    return list(df.columns), sorted(str([plain(v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) and name in ("recursive_split", "recursive_split_code")
    else:
        assert rows(got) == rows(duck.sql(sql).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0
