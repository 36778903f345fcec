"""Every core query against its SQL on the smallest tables, if they are on this machine."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__
from pairweave.plans import data_queries, graph_queries

FOLDER = Path("/root/testdata/sf0.001")
CORE = {**graph_queries.QUERIES, **data_queries.QUERIES}
SQL = {**graph_queries.ORACLE, **data_queries.ORACLE}


def value(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER / f}')")
    return con


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables on this machine")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = CORE[name](spark, str(FOLDER))
    said = duck.execute(SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, said.fetchall())


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables on this machine")
@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert CORE[name](spark, str(FOLDER)).collect() is not None


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables on this machine")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(SQL) <= set(CORE) and set(CORE) <= set(__spark_entry__.queries())
