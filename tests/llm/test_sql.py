"""The corpus queries give the rows of their SQL, and the general interfaces what they promise."""

import math
import os

import duckdb
import pytest

from wavelattice.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "benchmark", "pages", "conversations", "labels")


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df, relation = queries.QUERIES[name](spark, DATA), duck.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in relation.fetchall()), key=repr)
