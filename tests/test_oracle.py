"""Every query gives what its SQL counterpart gives in DuckDB, within the engine."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from oeuvre.catalogue import oracle, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FOREIGN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas", "BatchEvalPython")
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def lines(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("null" if r[i] is None else repr(r[i]) for i in order) for r in rows)


def test_every_query_has_a_counterpart():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql()[name]
    types = {r[0]: r[1] for r in duck.execute("DESCRIBE " + sql).fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert lines(df.columns, df.collect()) == lines(names, result.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FOREIGN if word in plan]


def test_entry(spark):
    assert entry.entry(spark).count() == 105
