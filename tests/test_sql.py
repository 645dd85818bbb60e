"""Every registered query with SQL gives the same rows as DuckDB does."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from vellum.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(x):
    x = x.tolist() if hasattr(x, "tolist") else x
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, FOLDER)
    want = duck.sql(driver.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
