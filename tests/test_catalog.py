"""Every registered query equals its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from check import TABLES, rows_of
from sitegrain.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(name, spark, con):
    df = all_queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(all_oracles()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cur.fetchall())
