"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from tidelake.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in os.listdir(SF)] if os.path.isdir(SF) else []

pytestmark = pytest.mark.skipif(not TABLES, reason="the driver's tables are not here")
ROWS_ONLY = {"train_score"}


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def in_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_only_the_fitted_model_has_no_oracle():
    assert QUERIES.keys() - ORACLES.keys() == ROWS_ONLY
    assert contract.oracle_sql().keys() <= contract.queries().keys()
    assert QUERIES.keys() <= contract.queries().keys()


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert node not in plan
    if name in ROWS_ONLY:
        assert rows
        return
    result = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert in_order(df.columns, [tuple(r) for r in rows]) == in_order(columns, result.fetchall())
