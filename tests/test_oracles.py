"""Every registered query that SQL can express gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from caselake.plans import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    there = [d[0] for d in duck.sql(f"DESCRIBE {ORACLES[name]}").fetchall()]
    assert sorted(there) == cols
    want = sorted((tuple(plain(r[there.index(c)]) for c in cols) for r in duck.sql(ORACLES[name]).fetchall()), key=repr)
    assert rows == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
