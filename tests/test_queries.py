"""Every registered query against its DuckDB equivalent at the smallest size."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tallyforge.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool":
            return str(bool(v))
        return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())
