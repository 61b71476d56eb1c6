"""Each registered query against its SQL in DuckDB; without SQL it must run with unique columns."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracemill.plans import registry


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


def rows(table, columns, names):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[k]) for k in at) for r in table), key=lambda r: tuple((v is None, v) if not isinstance(v, (list, bytes)) else (False, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = df.collect()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(want.columns) == columns
        assert rows(got, columns, df.columns) == rows(want.fetchall(), columns, want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
