"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from skein.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.execute(registry.ORACLE_SQL[name])
    assert columns == sorted(d[0] for d in want.description)
    names = [d[0] for d in want.description]
    show = lambda v: list(map(show, v)) if isinstance(v, list) else round(v, 6) if isinstance(v, float) else v
    rows = sorted(repr([show(dict(zip(names, r))[c]) for c in columns]) for r in want.fetchall())
    assert sorted(repr([show(r[c]) for c in columns]) for r in got.collect()) == rows


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
