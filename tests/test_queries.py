"""Every query with SQL against DuckDB on the smallest tables, cell by cell."""

import math
from pathlib import Path

import duckdb
import pytest

from sparkseek.plans import catalogue

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return x + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, con, sf, name):
    frame = catalogue.queries()[name](spark, sf)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[t] for c, t in frame.dtypes} == kinds
    at = [want.columns.index(c) for c in frame.columns]
    got = sorted((tuple(map(plain, r)) for r in frame.collect()), key=repr)
    rows = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert got == rows


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql_run(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0
