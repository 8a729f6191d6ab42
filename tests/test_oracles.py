"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from stratalith.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    show = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted((tuple(show(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0
