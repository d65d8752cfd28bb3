"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

from lumenframe import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert rows
    if sql := Q.oracle_sql().get(name):
        want = duck.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({sql})").fetchall()
        assert rows == sorted((tuple(map(plain, r)) for r in want), key=repr)
