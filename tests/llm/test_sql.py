"""Queries with a SQL counterpart give its rows; all queries are registered."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from oeuvre.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


def lines(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def test_all_are_registered():
    names = set(entry.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert "pipeline" in names
    assert set(queries.oracle_sql()) < set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert lines(df.columns, df.collect()) == lines(names, result.fetchall())


NATIVE = ("op3_licence_scan", "op4_secret_scan", "op6_mix_sources")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plan(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
