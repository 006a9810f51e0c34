"""Every query of the catalogue against its SQL in DuckDB: rows, column names and values."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import catalogue
from quillon.plans.adapters import TABLES
from tests.conftest import ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{ORACLE}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.Q))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.Q[name](spark, ORACLE)
    want = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(map(normal, r)) for r in got.select(*[f"`{n}`" for n in names]).collect())
    assert rows == sorted(tuple(map(normal, r)) for r in want.fetchall())
    assert rows


def test_entry(spark):
    assert os.path.isdir("/root/testdata/sf0.001") and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
