import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairweave.operators import components, edges, greedy, linkage
from pairweave.operators.assign import add_listed_objects, number_assignments, with_position
from pairweave.operators.leiden import cpm_quality, leiden, leiden_partition
from pairweave.plans.cluster import ClusterOptions, cluster


def graph(rng, n, m, values=(0.1, 0.2, 0.3)):
    out = {}
    while len(out) < m:
        a, b = rng.sample(range(n), 2)
        out[min(a, b), max(a, b)] = rng.choice(values)
    return out


def frames(spark, g, order):
    e = spark.createDataFrame([(f"v{a:03}", f"v{b:03}", d) for (a, b), d in g.items()], "src string, dst string, d double")
    ids = sorted({x for ab in g for x in ab}, key=order.index)
    v = spark.createDataFrame([(f"v{x:03}", i, i) for i, x in enumerate(ids)], "id string, appear_key long, proc_key long")
    return e, v, ids


def neighbours(g):
    out = defaultdict(dict)
    for (a, b), d in g.items():
        out[a][b] = out[b][a] = d
    return out


def sequential(g, ids, method):
    """The greedy methods, one object at a time."""
    nb, owner = neighbours(g), {}
    order = sorted(ids, key=lambda v: (-len(nb[v]), ids.index(v))) if method == "set-cover" else ids
    seeds = []
    for v in order:
        if method == "uclust":
            near = [(nb[v][s], ids.index(s), s) for s in seeds if s in nb[v]]
            if near:
                owner[v] = min(near)[2]
                continue
        elif v in owner:
            continue
        owner[v] = v
        seeds.append(v)
        if method != "uclust":
            for u in nb[v]:
                owner.setdefault(u, v)
    return {v: order.index(owner[v]) for v in ids}


METHODS = {"cd-hit": greedy.greedy_incremental, "uclust": greedy.closest_seed, "set-cover": greedy.set_cover}


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("small", [0, 10_000])
def test_greedy_family(spark, method, small):
    rng = random.Random(small + len(method))
    for n, m in ((25, 40), (40, 45)):
        g = graph(rng, n, m)
        order = rng.sample(range(n), n)
        e, v, ids = frames(spark, g, order)
        want = sequential(g, ids, method)
        got = {r["id"]: r["cluster_key"] for r in METHODS[method](e, v, small_graph=small).collect()}
        keys = sorted(set(got.values()))
        ranks = sorted(set(want.values()))
        assert {k: keys.index(c) for k, c in got.items()} == {f"v{x:03}": ranks.index(c) for x, c in want.items()}


def test_path_is_done_in_order(spark):
    n = 30
    g = {(i, i + 1): 0.1 for i in range(n - 1)}
    e, v, ids = frames(spark, g, list(range(n)))
    got = {r["id"]: r["cluster_key"] for r in greedy.greedy_incremental(e, v, small_graph=4).collect()}
    assert got == {f"v{x:03}": c for x, c in sequential(g, ids, "cd-hit").items()}


@pytest.mark.parametrize("small", [0, 10_000])
def test_components(spark, small):
    rng = random.Random(small)
    g = graph(rng, 60, 45) | {(100 + i, 101 + i): 0.1 for i in range(40)} | {(200, 201 + i): 0.1 for i in range(30)}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in g:
        root[find(a)] = find(b)
    e, v, ids = frames(spark, g, list(range(300)))
    got = {r["id"]: r["root"] for r in components.connected_components(e, small).collect()}
    parts, want = defaultdict(set), defaultdict(set)
    for x in ids:
        parts[got[f"v{x:03}"]].add(x)
        want[find(x)].add(x)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))
    assert components.connected_components(e.limit(0), small).collect() == []


def naive_complete(g, ids):
    """Merge the nearest pair of clusters, by (value, row, column), until none is left; roots, latest first."""
    cells = {(min(ids.index(a), ids.index(b)), max(ids.index(a), ids.index(b))): d for (a, b), d in g.items()}
    groups = {i: {x} for i, x in enumerate(ids)}
    new = len(ids)
    while cells:
        (a, b), _ = min(cells.items(), key=lambda x: (x[1], x[0]))
        groups[new] = groups.pop(a) | groups.pop(b)
        near = defaultdict(list)
        for (x, y), d in list(cells.items()):
            if {x, y} & {a, b}:
                del cells[x, y]
                if {x, y} != {a, b}:
                    near[x if y in (a, b) else y].append(d)
        for x, d in near.items():
            if len(d) == 2:
                cells[x, new] = max(d)
        new += 1
    return [groups[k] for k in sorted(groups, reverse=True)]


@pytest.mark.parametrize("n, m, values, limit", [(18, 30, (0.1, 0.2, 0.3), 9), (26, 45, (0.1, 0.2, 0.3), 1_000), (12, 40, (0.1, 0.2), 12), (12, 40, (0.1, 0.2), 1_000), (6, 15, (0.3,), 0), (14, 91, (0.3,), 40)])
def test_complete_linkage(spark, n, m, values, limit):
    """Pair by pair, ties included, whatever one task may hold; the last graph is one clique of equal distances."""
    rng = random.Random(n)
    g = graph(rng, n, m, values)
    order = rng.sample(range(n), n)
    e, v, ids = frames(spark, g, order)
    keyed = linkage.complete_linkage(e, v, component_edges=limit).collect()
    keys = sorted({tuple(r["cluster_key"]) for r in keyed})
    got = [{int(r["id"][1:]) for r in keyed if tuple(r["cluster_key"]) == k} for k in keys]
    assert got == naive_complete(g, ids)


def test_complete_rounds_run_over_levels(spark, monkeypatch):
    from pairweave.plans import graph_queries

    limits, tied = [], []
    level, oldest = linkage._level, linkage._oldest_cells
    monkeypatch.setattr(linkage, "_level", lambda cells, limit, small: limits.append(limit) or level(cells, limit, small))
    monkeypatch.setattr(linkage, "_oldest_cells", lambda *args: tied.append(1) or oldest(*args))
    names = [f"v{i}" for i in range(9)]
    rows = [(i, a, b, 0.97) for i, (a, b) in enumerate((a, b) for a in names for b in names if a < b)]
    table = spark.createDataFrame(rows, "row_id long, id1 string, id2 string, tani double")
    monkeypatch.setattr(graph_queries, "table", lambda *args: table)
    out = graph_queries.QUERIES["cluster_complete_rounds"](spark, "").collect()
    assert {r["cluster"] for r in out} == {0} and len(out) == 9
    assert len(limits) > 1 and tied and set(limits) == {graph_queries.ROUNDS_HOLD}


def test_leiden_cliques_and_quality(spark):
    cliques = {(10 * k + i, 10 * k + j): 0.1 for k in range(3) for i in range(5) for j in range(i + 1, 5)}
    e, v, ids = frames(spark, cliques | {(4, 10): 0.1, (14, 20): 0.1}, list(range(40)))
    for limit in (1_000, 0):
        got = defaultdict(set)
        for r in leiden(e, v, component_edges=limit).collect():
            got[r["cluster_key"]].add(int(r["id"][1:]) // 10)
        assert sorted(map(sorted, got.values())) == [[0], [1], [2]]
    alone = leiden(e, v, resolution=0.95).select("cluster_key").distinct().count()
    assert alone == len(ids)
    members = leiden(e, v).select("id", F.col("cluster_key").cast("string").alias("community"))
    single = v.select("id", F.col("id").alias("community"))
    assert cpm_quality(e, members, 0.7).first()[0] > cpm_quality(e, single, 0.7).first()[0]


def test_leiden_rounds_against_the_task(spark):
    rng = random.Random(3)
    g = graph(rng, 36, 150, (0.02, 0.1, 0.2))
    e, v, ids = frames(spark, g, list(range(36)))
    quality = {}
    for limit in (0, 1_000):
        members = leiden(e, v, component_edges=limit).select("id", F.col("cluster_key").cast("string").alias("community"))
        quality[limit] = cpm_quality(e, members, 0.7).first()[0]
        rows = members.collect()
        if not limit:
            where, nb = {int(r["id"][1:]): r["community"] for r in rows}, neighbours(g)
            for x in ids:  # nobody gains by moving, or by being alone
                gain = {c: sum(1 - d for y, d in nb[x].items() if where[y] == c) - 0.7 * sum(where[y] == c and y != x for y in ids) for c in {where[x], *(where[y] for y in nb[x])}}
                assert gain[where[x]] >= max(0.0, *gain.values()) - 1e-9
    assert quality[0] >= 0.95 * quality[1_000]


def test_single_linkage_merges(spark):
    rng = random.Random(5)
    g = graph(rng, 40, 70)
    e, _, _ = frames(spark, g, list(range(40)))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    want = []
    for d, a, b in sorted((d, a, b) for (a, b), d in g.items()):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want.append((len(want), f"v{a:03}", f"v{b:03}", d))
    assert [tuple(r) for r in components.single_linkage_merges(e).orderBy("step").collect()] == want
    assert components.single_linkage_merges(e.limit(0)).collect() == []


def test_leiden_partition_properties():
    rng = random.Random(1)
    for _ in range(20):
        g = graph(rng, 30, 60)
        es = [(a, b, 1 - d) for (a, b), d in g.items()]
        one, two = leiden_partition(30, es, 0.7, 0.01, 2, 7), leiden_partition(30, es, 0.7, 0.01, 2, 7)
        assert one == two
        assert leiden_partition(30, [(a, b, 2 * w) for a, b, w in es], 1.4, 0.02, 2, 7) == one
        nb = neighbours(g)
        for c in set(one):
            part = [x for x in range(30) if one[x] == c]
            seen, todo = {part[0]}, [part[0]]
            while todo:
                for y in nb[todo.pop()]:
                    if one[y] == c and y not in seen:
                        seen.add(y)
                        todo.append(y)
            assert seen == set(part)


def test_edges_with_every_kind_of_dirt(spark):
    rows = [("a", "b", 0.9, 1), ("b", "a", 0.95, 2), ("a", "b", 0.9, 3), ("a", "a", 1.0, 4), (None, "b", 0.9, 5), ("c", "d", None, 6), ("c", "e", float("nan"), 7), ("e", "f", float("inf"), 8), ("g", "h", 0.2, 9)]
    df = spark.createDataFrame(rows, "id1 string, id2 string, s double, o long").withColumn("d", F.lit("clash")).withColumn("src", F.lit(1))
    out = edges.surviving_pairs(df, ("id1", "id2"), "s", kind="similarity", minimum={"s": 0.5}, order=F.col("o"))
    found = [(r["src"], r["dst"], round(r["d"], 6)) for r in edges.canonical_edges(out).orderBy("src").collect()]
    assert found == [("a", "b", 0.05), ("e", "f", float("-inf"))]
    seen = {r["id"]: (r["appear_key"]["ord"], r["appear_key"]["pos"]) for r in edges.vertices(out).collect()}
    assert seen == {"a": (1, 0), "b": (1, 1), "e": (8, 0), "f": (8, 1)}
    assert edges.canonical_edges(out.limit(0)).collect() == []


def test_histogram(spark):
    e = spark.createDataFrame([("a", "b", 0.0), ("a", "c", 0.0005), ("a", "d", 0.9)], "src string, dst string, d double")
    bounds = edges.histogram_bounds()
    assert len(bounds) >= 50 and bounds[0] == 0.0
    got = {r["bin"]: (r["upper"], r["n"]) for r in edges.distance_histogram(e).collect()}
    assert got == {1: (0.001, 4), len(bounds): (None, 2)}


PAIRS = [("b", "a", 0.9), ("b", "c", 0.8), ("d", "e", 0.95), ("f", "f", 1.0), ("g", "h", 0.1)]


def pairs(spark):
    return spark.createDataFrame(PAIRS, "x string, y string, s double").withColumn("object", F.lit(1)).withColumn("cluster", F.lit(2))


def test_objects_and_errors(spark):
    objects = spark.createDataFrame([("z", 0), ("c", 1), ("b", 2), ("a", 3), ("e", 4), ("d", 5), ("y", 6)], "object string, gi long")
    out = cluster(pairs(spark), objects=objects, kind="similarity", minimum={"s": 0.5})
    got = [(r["object"], r["cluster"]) for r in out.orderBy("cluster_no", "out_key").collect()]
    assert got == [("c", 0), ("b", 0), ("a", 0), ("e", 1), ("d", 1), ("z", 2), ("y", 3)]
    reps = cluster(pairs(spark), objects=objects, kind="similarity", minimum={"s": 0.5}, representatives=True)
    assert {r["object"]: r["cluster"] for r in reps.collect()} == {"c": "c", "b": "c", "a": "c", "e": "e", "d": "e", "z": "z", "y": "y"}
    with pytest.raises(ValueError, match="isn't listed"):
        cluster(pairs(spark), objects=objects.filter("object <> 'a'"), kind="similarity", minimum={"s": 0.5}).collect()
    left = cluster(pairs(spark), objects=objects.filter("object <> 'a'"), kind="similarity", minimum={"s": 0.5}, missing="drop")
    assert left.count() == 6
    with pytest.raises(ValueError, match="more than once"):
        add_listed_objects(spark.createDataFrame([("a", 0)], "id string, cluster long"), objects.unionByName(objects))


def test_no_surviving_pair(spark):
    for algo in ("single", "complete", "uclust", "set-cover", "cd-hit", "leiden"):
        out = cluster(pairs(spark), algo=algo, kind="similarity", minimum={"s": 2.0})
        assert out.columns == ["object", "cluster", "out_key", "cluster_no"] and out.collect() == []
    objects = spark.createDataFrame([("z", 0), ("a", 1)], "object string, gi long")
    out = cluster(pairs(spark), objects=objects, kind="similarity", minimum={"s": 2.0})
    assert sorted((r["object"], r["cluster"]) for r in out.collect()) == [("a", 1), ("z", 0)]


@pytest.mark.parametrize("bad", [{"algo": "kmeans"}, {"id_cols": ("x", "x")}, {"id_cols": ("x", "q")}, {"id_cols": ("x", "s"), "distance_col": "s"}, {"distance_col": "q"}, {"minimum": {"x": 1}}, {"kind": "share"}, {"maximum": {"q": 1}}])
def test_refused_options(bad):
    with pytest.raises(ValueError):
        ClusterOptions(**bad).resolve(["x", "y", "s"])


def test_positions_need_no_global_window(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    for small in (0, 10_000):
        got = with_position(df.repartition(7), [F.asc("k")], "p", small).select("k", "p").collect()
        assert len(got) == 1000 and all(r["k"] == r["p"] for r in got)
    plan = with_position(df, [F.asc("k")], "p", 0)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert number_assignments(spark.createDataFrame([], "id string, cluster_key long")).collect() == []
