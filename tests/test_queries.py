"""Every registered query of the library against its SQL oracle on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from labelscope.plans.registry import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 5)
    return str(value)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_oracle(spark, duck, name):
    df = queries()[name](spark, DATA)
    found = df.collect()
    if name not in oracle_sql():
        assert df.columns
        return
    relation = duck.execute(oracle_sql()[name])
    names = [c[0] for c in relation.description]
    want = rows(names, relation.fetchall())
    got = rows(df.columns, found)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1.0, abs(y))), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(queries()) - set(oracle_sql()) == {"g14_views"}  # held against plain Python in test_operators
