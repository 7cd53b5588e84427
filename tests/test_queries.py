"""Every query with SQL against DuckDB on the smallest tables; the others must run with a stable schema."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

Q, O = entry.queries(), entry.oracle_sql()
CORE = [n for n in Q if n in O]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(f"{tiny}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_same_as_sql(spark, tiny, duck, name):
    df = Q[name](spark, tiny)
    cols = sorted(df.columns)
    rel = duck.sql(O[name])
    assert sorted(rel.columns) == cols
    got = Counter(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(str(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", [n for n in Q if n not in O])
def test_runs(spark, tiny, name):
    df = Q[name](spark, tiny)
    assert df.columns and df.count() >= 0


def test_every_sql_has_its_query():
    assert set(O) <= set(Q)


def test_entry_has_rows(spark, tiny):
    assert entry.entry(spark).count() > 0
