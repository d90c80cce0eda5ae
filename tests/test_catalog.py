"""Every query with a SQL twin gives its rows at the small scale."""

import math
import os

import duckdb
import pytest

from lodestrata import catalog

SF = "/root/testdata/sf0.001"


def plain(rows):
    cell = lambda x: None if x is None else ("nan" if math.isnan(x) else round(x, 5)) if isinstance(x, float) else str(x)
    return sorted((tuple(map(cell, r)) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
