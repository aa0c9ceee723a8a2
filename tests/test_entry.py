"""Every query of the core against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

CORE = {n: f for n, f in entry_module.catalog.QUERIES.items()}
SQL = entry_module.catalog.SQL


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    clean = lambda v: round(float(v), 5) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, small, name):
    df = CORE[name](spark, small)
    rows, cols = df.collect(), df.columns
    if name in SQL:
        res = con.execute(SQL[name])
        want = [c[0] for c in res.description]
        assert sorted(cols) == sorted(want)
        assert canon(rows, cols) == canon(res.fetchall(), want)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
