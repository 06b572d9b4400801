"""The serving queries and their SQL give the same rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quern.plans import queries, serving

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == serving.__name__]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({queries.ORACLE_SQL[name]})")
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
