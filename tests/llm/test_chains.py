import random
from collections import defaultdict

import pytest

from pairweave.llm.chains import compress_chains, match_groups, rank_chains, strip_leaves


def groups(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            up[find(a)] = find(b)
    parts = defaultdict(list)
    for x in up:
        parts[find(x)].append(x)
    return sorted((min(p), x) for p in parts.values() for x in p)


def run(spark, pairs, **named):
    df = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", "1 as group_id", "2 as object")
    return sorted((r["group_id"], r["object"]) for r in match_groups(df, **named).collect())


SHAPES = {
    "path": [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)],
    "shuffled path": [(f"p{i * 37 % 61:03}", f"p{(i + 1) * 37 % 61:03}") for i in range(60)],
    "cycle": [(f"c{i * 5 % 23:02}", f"c{(i + 1) * 5 % 23:02}") for i in range(23)],
    "star": [("z", f"s{i:02}") for i in range(30)],
    "loop on a hub": [("h", "l1"), ("l1", "l2"), ("l2", "l3"), ("l3", "h"), ("h", "x"), ("h", "y")],
    "two hubs": [(h, f"m{i}") for h in "qr" for i in range(6)] + [("q", "r")],
    "pairs": [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), (None, "d"), ("e", None), ("y", "x")],
    "triangle with tails": [("a", "b"), ("b", "c"), ("a", "c"), ("c", "t1"), ("t1", "t2"), ("t2", "t3")],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    assert run(spark, SHAPES[shape]) == groups(SHAPES[shape])


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"v{rng.randint(0, 80):02}", f"v{rng.randint(0, 80):02}") for _ in range(rng.choice([50, 70, 110]))]
    pairs += SHAPES["shuffled path"] + SHAPES["cycle"]
    assert run(spark, pairs, small_graph=0) == groups(pairs)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", "a"), (None, None)]) == []


def test_leaves_and_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    left, gone = strip_leaves(edges)
    assert left.collect() == [] and sorted(map(tuple, gone.collect())) == [("a", "b"), ("c", "b"), ("y", "x")]
    hubs = [("h", f"a{i}") for i in range(3)] + [("k", f"b{i}") for i in range(3)]
    chain = [("h", "m1"), ("m1", "m2"), ("k", "m2")]
    edges = spark.createDataFrame(hubs + chain, "src string, dst string")
    rest, removed = compress_chains(edges)
    assert ("h", "k") in set(map(tuple, rest.collect()))
    assert {r["id"] for r in removed.collect()} == {"m1", "m2"}


def test_ranking_takes_logarithmic_rounds(spark, monkeypatch):
    import pairweave.llm.chains as module

    calls, real = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: calls.append(1) or real(df))
    n = 200
    chain = spark.createDataFrame([(f"v{i:03}", f"v{i - 1:03}", f"v{i + 1:03}") for i in range(1, n)], "id string, low string, high string")
    ends = {(r["id"], r["end"]) for r in rank_chains(chain).collect()}
    assert ends == {(f"v{i:03}", e) for i in range(1, n) for e in ("v000", f"v{n:03}")}
    assert len(calls) <= 11
