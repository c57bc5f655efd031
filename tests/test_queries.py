"""Every forest query against its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from emberplane import registry

SF = "/root/testdata/sf0.001"


def rows(frame):
    def cell(v):
        if pd.isna(v):
            return ""
        return str(v) if isinstance(v, str | bool | pd.Timestamp) or not hasattr(v, "__float__") else f"{float(v):.4f}"

    return sorted("|".join(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
