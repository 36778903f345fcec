"""Every query of the subpackage on the smallest tables, against its SQL where it has any."""

import math
import os
import re
from pathlib import Path

import pytest

import __spark_entry__
from pairweave import llm

FOLDER = Path("/root/testdata/sf0.001")


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
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = llm.queries()[name](spark, str(FOLDER))
    said = duck.execute(llm.oracle_sql()[name])
    names = [d[0] for d in said.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, said.fetchall())


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables on this machine")
def test_groups_hold(spark):
    """What SQL can't say of p2: every pair comes once and in order, groups are whole and every member fits."""
    got = {tuple(r) for r in llm.queries()["p2_found"](spark, str(FOLDER)).collect()}
    similar = set()
    for r in spark.read.parquet(str(FOLDER / "vir61_ani.parquet")).collect():
        if r["ani"] is not None and not math.isnan(r["ani"]) and r["id1"] != r["id2"] and (r["ani"] / 100 if r["ani"] > 1 else r["ani"]) >= 0.95:
            similar |= {(r["id1"], r["id2"]), (r["id2"], r["id1"])}
    members = {}
    for a, b in got:
        assert a < b
        members.setdefault(a, {a}).add(b)
        members.setdefault(b, {b}).add(a)
    for x, group in members.items():
        assert all(members[y] == group for y in group)
        assert 2 * sum((x, y) in similar for y in group) > len(group) - 1
    described = llm.queries()["p2_groups"](spark, str(FOLDER)).collect()
    assert {(r["group_id"], r["size"]) for r in described} == {(min(g), len(g)) for g in members.values()}


def test_every_problem_has_its_query():
    names = set(__spark_entry__.queries())
    for n in (1, 2, 3, 4, 6, 8, 10):
        assert f"p{n}_found" in names
    assert any(re.match("p9_", x) for x in names)
    assert set(__spark_entry__.oracle_sql()) <= names
