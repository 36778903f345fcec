import random
from collections import defaultdict

import pytest

from pairweave.llm.top_items import top_items

SCHEMA = "g string, item string, score double, place int"


def expected(rows, n):
    best = defaultdict(dict)
    for g, i, s, _ in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g][i] = max(best[g].get(i, -9e9), s)
    return sorted((g, k + 1, i, s) for g, items in best.items() for k, (i, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n]))


@pytest.mark.parametrize("piece", [1, 40, 100_000])
@pytest.mark.parametrize("bounded", [1, 3, 100_000])
def test_against_brute_force(spark, piece, bounded):
    rng = random.Random(piece + bounded)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None, "", "c"]), rng.choice([None, "", "x", "y"] + [f"i{k}" for k in range(30)]), rng.choice([None, float("nan"), 0.0, 0.5, 0.5, 1.0, -1.0]), 9) for _ in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for n in (1, 3):
        got = sorted(map(tuple, top_items(df, n, bounded_groups=bounded, piece=piece).collect()))
        assert got == expected(rows, n)


def test_all_scores_equal_in_a_large_group(spark):
    rows = [("hot", f"i{k % 500:03}", 1.0, 0) for k in range(5000)]
    got = [r["item"] for r in top_items(spark.createDataFrame(rows, SCHEMA), 3, piece=700).orderBy("place").collect()]
    assert got == ["i000", "i001", "i002"]


def test_repeats_are_folded_before_the_shuffle(spark):
    """A group of many rows and two items has no bound; one row per item and task is what leaves a task."""
    df = spark.range(300_000).selectExpr("concat('hot', id % 1) as g", "concat('i', id % 2) as item", "cast(id % 7 as double) as score", "1 as place")
    out = top_items(df, 3)
    assert [tuple(r) for r in out.orderBy("place").collect()] == [("hot0", 1, "i0", 6.0), ("hot0", 2, "i1", 6.0)]
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [i for i, line in enumerate(lines) if " Exchange hashpartitioning" in line]
    assert any("Aggregate" in line and "partial_max" in line for line in lines[exchanges[-1] + 1 :])
    assert any("WindowGroupLimit" in line and "Partial" in line for line in lines)


def test_empty(spark):
    assert top_items(spark.createDataFrame([], SCHEMA), 3).collect() == []
    assert top_items(spark.createDataFrame([(None, "a", 1.0, 0), ("g", "a", None, 0)], SCHEMA), 3).collect() == []
