"""Every library query against DuckDB on the smallest tables."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from millrace import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"create view {n} as select * from '{small}/{n}.parquet'")
    return c


def plain(value):
    return round(value, 6) if isinstance(value, float) else float(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query_equals_oracle(spark, duck, small, name):
    found = library.QUERIES[name](spark, small)
    columns = sorted(found.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    relation = duck.sql(library.ORACLE[name])
    places = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert ours == sorted((tuple(plain(r[i]) for i in places) for r in relation.fetchall()), key=repr)


def test_every_query_has_an_oracle():
    assert set(library.QUERIES) == set(library.ORACLE)
