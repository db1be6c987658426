"""The registered queries: twins in DuckDB, names, and the entry's guard."""

import re

import duckdb
import pytest

from certlens.llm.oracle import ORACLE_SQL
from certlens.llm.queries import QUERIES

SMOKE = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMOKE}/{table}.parquet'")
    rows = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in rows.description]
    expected = sorted(rows.fetchall(), key=str)
    df = QUERIES[name](spark, SMOKE)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_returns_a_row_for_each_input(spark, name):
    df = QUERIES[name](spark, SMOKE)
    count = lambda t: spark.read.parquet(f"{SMOKE}/{t}.parquet").count()
    rows = {"op1": lambda: count("documents") + count("pages"), "op2": lambda: 10 * spark.read.parquet(f"{SMOKE}/embeddings.parquet").filter("vec_id % 100 = 0").count(),
            "op4": lambda: count("documents"), "op6": lambda: count("pages"), "op7": lambda: 1 + spark.read.parquet(f"{SMOKE}/conversations.parquet").select("conv_id").distinct().count(),
            "op8": lambda: count("documents"), "op9": lambda: count("documents")}[name.split("_")[0]]()
    assert df.count() == rows


def test_entry_registers_them():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
