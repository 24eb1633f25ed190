"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    a, b = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    exact = [c for c in cols if a[c].dtype.kind != "f"] + [c for c in cols if a[c].dtype.kind == "f"]
    a, b = (x[exact].sort_values(exact).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-4, equal_nan=True), c
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() > 0


def test_all_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
