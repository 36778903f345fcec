"""Leiden communities under the constant Potts model, edge weight ``1 - d``, one edge per pair.

The quality of a partition is the sum over communities of the weight inside minus ``resolution`` times the number of
vertex pairs inside. Communities never gain from vertices that no path joins, so components are independent.
"""

from __future__ import annotations

import math
import random
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.operators.components import connected_components
from pairweave.operators.edges import degrees, symmetrize
from pairweave.operators.rounds import SMALL_GRAPH, follow_to_roots, is_empty, per_component
from pairweave.operators.skew import heavy_split_join, label_ends
from pairweave.runtime import cut, derived, materialised

#: Components of more edges than this are solved in distributed rounds instead of one task.
COMPONENT_EDGES = 500_000


def _move(adj: list[dict[int, float]], size: list[int], comm: list[int], gamma: float, rng: random.Random) -> None:
    """Move vertices to the neighbouring community of largest gain until none gains."""
    total = {}
    for v, c in enumerate(comm):
        total[c] = total.get(c, 0) + size[v]
    order = list(range(len(adj)))
    rng.shuffle(order)
    queue, waiting = deque(order), set(order)
    fresh = max(comm, default=-1) + 1
    while queue:
        v = queue.popleft()
        waiting.discard(v)
        old = comm[v]
        total[old] -= size[v]
        to: dict[int, float] = {}
        for u, w in adj[v].items():
            to[comm[u]] = to.get(comm[u], 0.0) + w
        best, gain = old, to.get(old, 0.0) - gamma * size[v] * total[old]
        for c, w in sorted(to.items()):
            g = w - gamma * size[v] * total[c]
            if g > gain + 1e-12:
                best, gain = c, g
        if gain < -1e-12:
            best = fresh
            fresh += 1
        total[best] = total.get(best, 0) + size[v]
        if best != old:
            comm[v] = best
            for u in adj[v]:
                if comm[u] != best and u not in waiting:
                    waiting.add(u)
                    queue.append(u)


def _refine(adj: list[dict[int, float]], size: list[int], comm: list[int], gamma: float, beta: float, rng: random.Random) -> list[int]:
    """Split every community into well-connected parts, merging single vertices at random, better gains likelier."""
    n = len(adj)
    part, alone = list(range(n)), [True] * n
    part_size = list(size)
    comm_size: dict[int, int] = {}
    for v, c in enumerate(comm):
        comm_size[c] = comm_size.get(c, 0) + size[v]
    inside = [sum(w for u, w in adj[v].items() if comm[u] == comm[v]) for v in range(n)]
    cut_weight = list(inside)  # weight from a part to the rest of its community
    order = list(range(n))
    rng.shuffle(order)
    for v in order:
        whole = comm_size[comm[v]]
        if not alone[v] or part_size[part[v]] != size[v] or inside[v] < gamma * size[v] * (whole - size[v]) - 1e-12:
            continue
        to: dict[int, float] = {}
        for u, w in adj[v].items():
            if comm[u] == comm[v]:
                to[part[u]] = to.get(part[u], 0.0) + w
        choices, weights = [part[v]], [1.0]
        for p, w in sorted(to.items()):
            gain = w - gamma * size[v] * part_size[p]
            if p != part[v] and gain >= 0 and cut_weight[p] >= gamma * part_size[p] * (whole - part_size[p]) - 1e-12:
                choices.append(p)
                weights.append(math.exp(min(gain / beta, 600.0)))
        p = rng.choices(choices, weights)[0]
        if p != part[v]:
            part_size[part[v]] -= size[v]
            cut_weight[p] += cut_weight[part[v]] - 2 * to[p]
            part[v] = p
            part_size[p] += size[v]
            alone[v] = False
            for u in adj[v]:
                if part[u] == p:
                    alone[u] = False
    return part


def leiden_partition(n: int, edges: list[tuple[int, int, float]], gamma: float, beta: float, iterations: int, seed: int) -> list[int]:
    """Community of each of ``n`` vertices. The same seed gives the same result."""
    rng = random.Random(seed)
    base: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        base[a][b] = base[b][a] = w
    member = list(range(n))
    for _ in range(max(1, iterations)):
        adj, size = base, [1] * n
        comm, node_of = list(member), list(range(n))
        while True:
            _move(adj, size, comm, gamma, rng)
            if len(set(comm)) == len(adj):
                break
            part = _refine(adj, size, comm, gamma, beta, rng)
            index = {p: i for i, p in enumerate(dict.fromkeys(part))}
            if len(index) == len(adj):  # nothing merged: collapse whole communities instead
                part = comm
                index = {p: i for i, p in enumerate(dict.fromkeys(part))}
            lower = [index[p] for p in part]
            new_adj: list[dict[int, float]] = [{} for _ in index]
            new_size, new_comm = [0] * len(index), [0] * len(index)
            for v, x in enumerate(lower):
                new_size[x] += size[v]
                new_comm[x] = comm[v]
                for u, w in adj[v].items():
                    if (y := lower[u]) != x:
                        new_adj[x][y] = new_adj[x].get(y, 0.0) + w
            node_of = [lower[x] for x in node_of]
            adj, size, comm = new_adj, new_size, new_comm
        after = [comm[x] for x in node_of]
        canon = {c: i for i, c in enumerate(dict.fromkeys(after))}
        after = [canon[c] for c in after]
        if after == member:
            break
        member = after
    return member


def _communities(pdf: pd.DataFrame, gamma: float, beta: float, iterations: int, seed: int) -> list[tuple]:
    rows = sorted(zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["d"].tolist()))
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    code = {x: i for i, x in enumerate(names)}
    edges = [(code[a], code[b], 1.0 - d) for a, b, d in rows]
    member = leiden_partition(len(names), edges, gamma, beta, iterations, seed)
    first: dict[int, object] = {}
    for name, c in zip(names, member):
        first.setdefault(c, name)
    return [(name, first[c]) for name, c in zip(names, member)]


#: Gains below this are rounding.
LEAST_GAIN = 1e-9


def _merged(arcs: DataFrame, nodes: DataFrame, gamma: float) -> DataFrame | None:
    """``(id, root)`` for the nodes that join others, by merging pairs that gain most for both, until none gains.

    ``arcs(src, dst, w)`` holds both directions; ``nodes(id, n, whole)`` sizes, and where ``whole`` isn't null, the
    size of the community that a node may merge within: then both partners must be well connected to the rest of it,
    by at least ``gamma`` times their size times that of the rest. Arcs are contracted after every round.
    """
    steps: list[DataFrame] = []
    arcs, nodes = cut(arcs.select("src", "dst", "w")), cut(nodes.select("id", "n", "whole"))
    while True:
        n_arcs = arcs.count()
        if not n_arcs:
            break
        ends = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("out")).join(nodes, "id")
        sound = F.col("whole").isNull() | (F.col("out") >= gamma * F.col("n") * (F.col("whole") - F.col("n")) - LEAST_GAIN)
        labels = cut(ends.select("id", "degree", F.struct("n", sound.alias("sound")).alias("c")))
        gain = F.col("w") - gamma * F.col("a.n") * F.col("b.n")
        rated = label_ends(arcs, labels, n_arcs).filter("a.sound and b.sound").select("src", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), F.round(gain, 12).alias("gain"))
        best = rated.filter(F.col("gain") > LEAST_GAIN).groupBy("src").agg(F.min(F.struct((-F.col("gain")).alias("neg"), "x", "y")).alias("o"))
        pairs = cut(best.groupBy(F.col("o.x").alias("parent"), F.col("o.y").alias("id")).agg(F.count(F.lit(1)).alias("k")).filter("k = 2").select("id", "parent"))
        if is_empty(pairs):
            break
        steps.append(pairs)
        named = cut(derived(labels, "id", "degree").join(pairs, "id", "left").select("id", "degree", F.coalesce("parent", "id").alias("c")))
        arcs = cut(label_ends(arcs, named, n_arcs).filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        nodes = cut(nodes.join(pairs, "id", "left").groupBy(F.coalesce("parent", "id").alias("id")).agg(F.sum("n").alias("n"), F.first("whole").alias("whole")))
    if not steps:
        return None
    forest = steps[0]
    for step in steps[1:]:
        forest = forest.unionByName(step)
    return follow_to_roots(forest)


def _moved(arcs: DataFrame, state: DataFrame, n_arcs: int, gamma: float, turn: int) -> DataFrame | None:
    """The state after one round of moves of nodes ``state(id, size, degree, c)`` to the community they gain most by;
    None if no node gains.

    Of the moves that gain, those are made that gain most of all from or to either of their two communities. No two of
    them share a community, so their gains add up and every round raises the quality. A node that is best off alone
    founds a community named after itself and the ``turn``.
    """
    labels = cut(state.select("id", "degree", F.struct("c", "size").alias("c")))
    toward = label_ends(arcs, labels, n_arcs).groupBy("src", "a", F.col("b.c").alias("b")).agg(F.sum("w").alias("w"))
    sizes = cut(state.groupBy(F.col("c").alias("b")).agg(F.sum("size").alias("n"), F.sum("degree").alias("arcs")))
    here = F.col("a.c") == F.col("b")
    gain = F.round(F.col("w") - gamma * F.col("a.size") * (F.col("n") - F.when(here, F.col("a.size")).otherwise(0)), 12)
    rated = heavy_split_join(toward, sizes, "b", "arcs", n_arcs).select("src", "b", here.alias("here"), gain.alias("gain"))
    best = rated.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("gain")).alias("neg"), (~F.col("here")).alias("away"), F.col("b").alias("c"))).alias("best"), F.max(F.when(F.col("here"), F.col("gain"))).alias("now"))
    own = heavy_split_join(state, derived(sizes, F.col("b").alias("c"), "n", "arcs"), "c", "arcs", n_arcs).join(best, "id", "left")
    now = F.coalesce("now", -gamma * F.col("size") * (F.col("n") - F.col("size")))
    there = F.coalesce(-F.col("best.neg"), F.lit(0.0))
    alone = F.struct(F.col("id").alias("id"), F.lit(turn).cast("long").alias("turn"))
    wants = own.select("id", F.col("c").alias("own"), F.when(there > 0, F.col("best.c")).otherwise(alone).alias("goal"), (F.greatest(there, F.lit(0.0)) - now).alias("gained"))
    wants = cut(wants.filter((F.col("gained") > LEAST_GAIN) & (F.col("own") != F.col("goal"))))
    if is_empty(wants):
        return None
    moves = wants.select(F.struct((-F.col("gained")).alias("neg"), "id").alias("key"), F.explode(F.array("own", "goal")).alias("c"))
    first = moves.groupBy("c").agg(F.min("key").alias("key")).groupBy(F.col("key.id").alias("id")).agg(F.count(F.lit(1)).alias("k")).filter("k = 2")
    made = wants.join(first, "id").select("id", "goal")
    return cut(state.join(made, "id", "left").select("id", "size", "degree", F.coalesce("goal", "c").alias("c")))


def _settled(arcs: DataFrame, state: DataFrame, n_arcs: int, gamma: float, turn: int) -> tuple[DataFrame, int, bool]:
    """Merge whole communities and move nodes until neither gains: (state, next turn, whether anything changed)."""
    changed = False
    while True:
        between = label_ends(arcs, state, n_arcs).filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        sizes = state.groupBy(F.col("c").alias("id")).agg(F.sum("size").alias("n"), F.sum("degree").alias("arcs"))
        roots = _merged(between, sizes.withColumn("whole", F.lit(None).cast("long")), gamma)
        if roots is not None:
            named = roots.select(F.col("id").alias("c"), "root").join(sizes.select(F.col("id").alias("c"), "arcs"), "c")
            state = cut(heavy_split_join(state, named, "c", "arcs", n_arcs, how="left").select("id", "size", "degree", F.coalesce("root", "c").alias("c")))
        n_moves = 0
        while (moved := _moved(arcs, state, n_arcs, gamma, turn)) is not None:
            state, turn, n_moves = moved, turn + 1, n_moves + 1
        changed = changed or roots is not None or n_moves > 0
        if not n_moves:
            return state, turn, changed


def leiden_rounds(edges: DataFrame, gamma: float, *, iterations: int = 2) -> DataFrame:
    """``(id, community)`` by distributed rounds, for components that no single task should hold.

    The three phases of the method over the whole graph: communities merge and vertices move until neither gains
    (:func:`_settled`); every community is refined from single vertices into well-connected parts (:func:`_merged`);
    parts become the vertices of the next level, where they move as wholes. Levels end when nothing changes any more,
    and all of it is done again from the single vertices, ``iterations`` times in all or until it changes nothing.
    Every step raises the quality, so there is no limit of rounds; of several best merges the first is taken, where
    :func:`leiden_partition` draws one. Communities are connected.
    """
    base = cut(symmetrize(edges).select("src", "dst", (1.0 - F.col("d")).alias("w")))
    degree = base.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    name = F.struct(F.col("id").alias("id"), F.lit(0).cast("long").alias("turn"))
    member, turn = cut(degree.select("id", F.lit(1).cast("long").alias("size"), "degree", name.alias("c"))), 1
    n_base, n_vertices = base.count(), member.count()
    for _ in range(max(1, iterations)):
        arcs, n_arcs, state, lower = base, n_base, member, None  # lower: vertices to the nodes of the level
        level, changed_ever = 0, False
        while True:
            state, turn, changed = _settled(arcs, state, n_arcs, gamma, turn)
            changed_ever = changed_ever or changed
            if level and not changed:
                break
            sizes = cut(state.groupBy("c").agg(F.sum("size").alias("whole"), F.sum("degree").alias("arcs")))
            nodes = heavy_split_join(state, sizes, "c", "arcs", n_arcs).select("id", F.col("size").alias("n"), "whole")
            parts = _merged(label_ends(arcs, state, n_arcs).filter("a = b").select("src", "dst", "w"), nodes, gamma)
            if parts is None:
                break
            named = cut(state.join(parts, "id", "left").select("id", "size", "degree", F.coalesce("root", "id").alias("p"), F.col("c").alias("of")))
            placed = derived(named, "id", F.col("p").alias("node"), F.col("size").alias("n"))
            lower = derived(placed, "id", "node") if lower is None else cut(heavy_split_join(lower.withColumnRenamed("node", "up"), derived(placed, F.col("id").alias("up"), "node", "n"), "up", "n", n_vertices).select("id", "node"))
            arcs = cut(label_ends(arcs, derived(named, "id", "degree", F.col("p").alias("c")), n_arcs).filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
            n_arcs = arcs.count()
            degrees = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
            state = named.groupBy(F.col("p").alias("id")).agg(F.sum("size").alias("size"), F.first("of").alias("c")).join(degrees, "id", "left")
            state = cut(state.select("id", "size", F.coalesce("degree", F.lit(0)).alias("degree"), "c"))
            level += 1
        if lower is None:
            member = state
        else:
            top = derived(state, F.col("id").alias("node"), "c", F.col("size").alias("n"))
            joined = heavy_split_join(lower, top, "node", "n", n_vertices).select("id", "c")
            member = cut(member.drop("c").join(joined, "id"))
        if not changed_ever:
            break
    inside = label_ends(base, member, n_base).filter("a = b and src < dst").select("src", "dst")
    parts = connected_components(inside).select("id", F.col("root").alias("part"))
    return member.select("id").join(parts, "id", "left").select("id", F.coalesce("part", "id").alias("community"))


def leiden(edges: DataFrame, vertices: DataFrame, *, resolution: float = 0.7, beta: float = 0.01, iterations: int = 2, seed: int = 1, component_edges: int = COMPONENT_EDGES, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """``(id, cluster_key)``: the first member's ``appear_key`` of each community.

    Each connected component is one grouped task; components of more than ``component_edges`` edges go through
    :func:`leiden_rounds`, which has the same phases. Vertices without an edge stand alone. An empty graph gives an
    empty result.
    """
    edges = materialised(edges)
    roots = cut(connected_components(edges, small_graph))
    placed = cut(edges.join(roots.select(F.col("id").alias("src"), F.col("root").alias("comp")), "src").select("comp", "src", "dst", "d"))
    id_type = edges.schema["src"].dataType.simpleString()
    large = cut(placed.groupBy("comp").count().filter(F.col("count") > component_edges).select("comp"))
    giant = not is_empty(large)
    within = placed.join(large, "comp", "left_anti") if giant else placed
    found = per_component(within, lambda pdf: _communities(pdf, resolution, beta, iterations, seed), f"id {id_type}, community {id_type}")
    if giant:
        found = found.unionByName(leiden_rounds(placed.join(large, "comp", "left_semi").select("src", "dst", "d"), resolution, iterations=iterations))
    labelled = cut(vertices.join(found, "id", "left").withColumn("community", F.coalesce("community", "id")))
    keys = labelled.groupBy("community").agg(F.min("appear_key").alias("cluster_key"), F.count(F.lit(1)).alias("n"))
    return heavy_split_join(labelled, keys, "community", "n", labelled.count()).select("id", "cluster_key")


def cpm_quality(edges: DataFrame, members: DataFrame, resolution: float) -> DataFrame:
    """One row ``(quality)``: weight inside communities minus ``resolution`` times the pairs inside."""
    ends = degrees(edges).join(members, "id").select("id", F.col("community").alias("c"), "degree")
    edges = materialised(edges)
    inside = label_ends(edges, cut(ends), edges.count()).filter("a = b").select((1.0 - F.col("d")).alias("q"))
    n = F.col("count")
    pairs = members.groupBy("community").count().select((-F.lit(resolution) * n * (n - 1) / 2).alias("q"))
    return inside.unionByName(pairs).agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("quality"))
