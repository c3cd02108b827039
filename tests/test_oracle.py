"""Every query against the same in SQL, over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from refloom.queries import QUERIES, SQL
from tests.conftest import SF

KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def value(v):
    return f"{v:.9g}" if isinstance(v, float) else None if v is None else str(v)


def rows(columns, found, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(value(r[i]) for i in at) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    ours = rows(df.columns, df.collect(), sorted(df.columns))
    assert name in SQL
    theirs = duck.sql(SQL[name])
    assert sorted(theirs.columns) == sorted(df.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    assert ours == rows(theirs.columns, theirs.fetchall(), sorted(df.columns))
