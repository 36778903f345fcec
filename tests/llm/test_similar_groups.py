import random
from collections import defaultdict
from itertools import combinations

from pairweave.llm.similar_groups import hashed_vectors, k_means, member_pairs, similar_groups, trimmed

SCHEMA = "a string, b string, s double, group_id int"


def planted(seed, sizes, keep=0.85, stray=12):
    rng = random.Random(seed)
    names = [f"g{i:03}" for i in range(sum(sizes))]
    rng.shuffle(names)
    groups, at = [], 0
    for n in sizes:
        groups.append(names[at : at + n])
        at += n
    rows = []
    for g in groups:
        for a, b in combinations(g, 2):
            if len(g) < 5 or rng.random() < keep:
                rows.append((a, b, 0.95 + rng.random() / 20, 1) if rng.random() < 0.5 else (b, a, 0.97, 1))
    owner = {x: i for i, g in enumerate(groups) for x in g}
    large = [x for g in groups if len(g) >= 5 for x in g]
    while stray:
        a, b = rng.sample(large, 2)
        if owner[a] != owner[b]:
            rows.append((a, b, 0.95, 1))
            stray -= 1
    return groups, rows


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    groups, described = similar_groups(df)
    out = defaultdict(set)
    for r in groups.collect():
        out[r["group_id"]].add(r["id"])
    return out, {r["group_id"]: (r["size"], r["typical"]) for r in described.collect()}


def test_planted_groups(spark):
    want, rows = planted(1, [12, 9, 8, 7, 6, 5, 3, 3, 2, 2])
    rows += rows[:5] + [(b, a, s, g) for a, b, s, g in rows[:5]] + [("x", "x", 1.0, 0), (None, "x", 1.0, 0), ("y", "z", None, 0)]
    got, described = found(spark, rows)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    for g, (size, typical) in described.items():
        assert g == min(got[g]) and size == len(got[g]) and len(typical) == min(3, size) and set(typical) <= got[g]


def test_rule_holds_on_any_graph(spark):
    rng = random.Random(7)
    rows = [(f"v{a:02}", f"v{b:02}", 0.96, 0) for a, b in (rng.sample(range(40), 2) for _ in range(110))]
    got, _ = found(spark, rows)
    near = defaultdict(set)
    for a, b, _, _ in rows:
        near[a].add(b)
        near[b].add(a)
    members = [x for g in got.values() for x in g]
    assert len(members) == len(set(members))
    for g in got.values():
        assert len(g) >= 2 and all(2 * len(near[x] & g) > len(g) - 1 for x in g)


def test_k_means_makes_the_groups(spark):
    """The trim only takes members out: from records alone, without k-means, it has no group to return."""
    want, rows = planted(3, [9, 8, 7, 6, 5])
    pairs = [(a, b, s) for a, b, s, _ in rows]
    arcs = spark.createDataFrame(pairs + [(b, a, s) for a, b, s in pairs], "src string, dst string, s double").groupBy("src", "dst").max("s").toDF("src", "dst", "s")
    vectors = hashed_vectors(arcs)
    alone = vectors.select("id", "degree", vectors["id"].alias("c"))
    assert trimmed(arcs, alone).collect() == []
    by = defaultdict(set)
    for r in k_means(arcs, vectors).collect():
        by[r["c"]].add(r["id"])
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want))
    assert all(len(r["x"]) == 128 for r in vectors.collect())


def test_trim_leaves_what_holds(spark):
    rng = random.Random(11)
    names = [f"v{i:02}" for i in range(40)]
    rows = [(a, b) for a, b in combinations(names, 2) if rng.random() < 0.5]
    near = {x: {b if a == x else a for a, b in rows if x in (a, b)} for x in names}
    arcs = spark.createDataFrame(rows + [(b, a) for a, b in rows], "src string, dst string")
    for parts in (1, 2, 4):
        state = spark.createDataFrame([(x, len(near[x]), f"c{i % parts}") for i, x in enumerate(names)], "id string, degree long, c string")
        by = defaultdict(set)
        for r in trimmed(arcs, state).collect():
            by[r["c"]].add(r["id"])
        assert by and all(len(g) > 1 and all(2 * len(near[x] & g) > len(g) - 1 for x in g) for g in by.values())


def test_hub_has_a_vector_like_any_other(spark):
    rows = [("hub", f"leaf{i:03}", 0.97, 0) for i in range(400)] + [(a, b, 0.99, 0) for a, b in combinations("pqrs", 2)] + [("hub", "p", 0.95, 0)]
    got, _ = found(spark, rows)
    assert set("pqrs") in got.values()
    assert all(len(g) == 2 for g in got.values() if g != set("pqrs"))


def test_pendant_is_not_a_member(spark):
    rows = [(a, b, 0.99, 0) for a, b in combinations("abcd", 2)] + [("d", "e", 0.99, 0)]
    got, _ = found(spark, rows)
    assert list(got.values()) == [set("abcd")]


def test_pairs_in_blocks(spark):
    rows = [("big", f"m{i:02}") for i in range(30)] + [("two", "x"), ("two", "y")]
    got = member_pairs(spark.createDataFrame(rows, "group_id string, id string"), block=4).collect()
    assert sorted(map(tuple, got)) == sorted([tuple(p) for p in combinations([f"m{i:02}" for i in range(30)], 2)] + [("x", "y")])


def test_empty(spark):
    assert found(spark, []) == ({}, {})
