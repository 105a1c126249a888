"""Every registered query of the core against its DuckDB twin, at the smallest size."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from veritrail.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()

    def plain(x):
        if pd.isna(x):
            return "NULL"
        if isinstance(x, bool) or str(type(x)).endswith("bool'>"):
            return str(bool(x))
        if isinstance(x, pd.Timestamp):
            return str(x)[:10]
        try:
            return str(int(x)) if float(x) == int(x) else str(x)
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
