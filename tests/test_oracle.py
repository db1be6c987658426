"""Every registered query against its DuckDB twin on the sf0.001 tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from certlens import catalog
from tests.conftest import SMOKE

TABLES = ["customer", "events", "pages", "nation", "region", "supplier", "part", "orders", "lineitem"]
SQL = catalog.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SMOKE)
    res = duck.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, res.fetchall())


def test_entry_smoke(spark):
    assert E.entry(spark).count() == 90
    assert set(catalog.queries()) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_queries_without_a_twin_return_rows(spark, name):
    assert catalog.queries()[name](spark, SMOKE).count() > 0
