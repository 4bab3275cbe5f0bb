"""Registered queries of the subpackage against their SQL on the smallest tables."""

import duckdb
import pytest

from skein.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    want = db.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    names = [d[0] for d in want.description]
    rows = sorted(repr([dict(zip(names, r))[c] for c in columns]) for r in want.fetchall())
    got = queries.QUERIES[name](spark, DATA)
    assert set(columns) <= set(got.columns)
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == rows
