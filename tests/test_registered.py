"""Every registered query next to its SQL on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SMALL
from driftgate.plans.oracle import all_sql
from driftgate.plans.queries import all_queries

_spec = importlib.util.spec_from_file_location(
    "check_queries", Path(__file__).resolve().parent.parent / "tools" / "check_queries.py"
)
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_names_agree():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


# the sketch runs take many rounds here; tools/check_queries.py covers them
@pytest.mark.parametrize("name", sorted(set(SQL) - {"monitor_f2_rebalance", "monitor_f2_window"}))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    cursor = db.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    mine = check.canonical([tuple(r) for r in df.collect()], df.columns)
    assert mine == check.canonical(cursor.fetchall(), names)


def test_entry(spark):
    assert contract.entry(spark).columns == ["round", "ts", "estimate"]
