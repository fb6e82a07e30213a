"""Every registered query runs on the smallest tables; those with SQL equal DuckDB's rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

from ragloom import catalog

SF = os.environ.get("RAGLOOM_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "-"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
