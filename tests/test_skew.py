import random
from collections import defaultdict

import pytest

from pairweave.operators.skew import heavy_keys, heavy_split_join, key_profile

SCHEMA = "rid long, k string, p string, v double, n_rows int"


def expected(rows):
    out = {}
    by = defaultdict(list)
    for _, k, p, v, _ in rows:
        by[k].append((p, v))
    for k, items in by.items():
        good = [(-v, p) for p, v in items if p is not None and v is not None and v == v and 0 <= v <= 1 and p != k and k is not None]
        best = min(good, default=(None, None))
        out[k] = (len(items), len({p for p, _ in items if p is not None}), None if best[0] is None else -best[0], best[1])
    return out


def found(df):
    return {r["object"]: (r["n_rows"], r["n_partners"], r["best"], r["best_partner"]) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_profile_with_heavy_keys_and_pairs(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for i in range(3000):
        k = rng.choice(["hot"] * 6 + ["", "k", None, "b", "c", "d"])
        p = "same" if k == "hot" and rng.random() < 0.6 else rng.choice([None, "", "hot", "b", "x", "y", f"p{rng.randint(0, 40)}"])
        rows.append((i, k, p, rng.choice([None, float("nan"), -1.0, 2.0, 0.0, 0.5, 1.0, rng.random()]), 7))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(key_profile(df, "k", "p", "v", "rid", partitions=partitions)) == expected(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert key_profile(df, "k", "p", "v", "rid").collect() == []
    assert heavy_keys(key_profile(df, "k", "p", "v", "rid"), 0.02).collect() == []


def test_heavy_keys_count_all_rows(spark):
    rows = [(i, "a", "x", 0.5, 0) for i in range(4)] + [(9 + i, None, "x", 0.5, 0) for i in range(4)] + [(99, "b", "x", 0.5, 0), (100, "c", "x", 0.5, 0)]
    profile = key_profile(spark.createDataFrame(rows, SCHEMA), "k", "p", "v", "rid")
    assert [r[0] for r in heavy_keys(profile, 0.4).collect()] == ["a"]
    assert sorted(r[0] for r in heavy_keys(profile, 0.1).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("share", [1, 3, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_split_join_is_a_join(spark, share, how):
    left = [(k, i) for i, k in enumerate(["a"] * 20 + ["b"] * 3 + ["c", "zz", None])]
    right = [("a", 20, 1), ("b", 3, 2), ("c", 1, 3), ("d", 0, 4)]
    a, b = spark.createDataFrame(left, "key string, i long"), spark.createDataFrame(right, "key string, n long, x int")
    for small in (0, 10):
        got = heavy_split_join(a, b, "key", "n", len(left), how=how, share=share, small_side=small)
        assert sorted(map(str, got.collect())) == sorted(map(str, a.join(b.drop("n"), "key", how).collect()))
