"""Each query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from weftline.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def cell(value):
    if pd.isna(value):
        return ""
    if isinstance(value, str):
        return value
    return f"{value:.4f}" if value % 1 else str(int(value))


def rows(frame):
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toPandas(), tables.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_all_names():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
