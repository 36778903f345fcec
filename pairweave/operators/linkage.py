"""Complete linkage on a sparse graph, where a missing pair is infinitely far apart.

Pairs merge one by one in the order (distance, row, column), where rows and columns are vertices by first appearance
followed by merged nodes by age. A merged cell is never before the two cells it comes from, so merges come in the order
of their cells, and the age of a node can be told from how it was made: its *key* is ``[0, rank]`` for a vertex and
``[1, distance, *key of the older part]`` for a merged node, and keys compare like ages wherever the nodes were made.
Two facts follow that let any graph be solved in parts, ties included:

* merges up to a distance t happen within the components of the cells up to t;
* where all cells are equal, nodes are taken in order of age, each with its oldest neighbour that is left.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.operators.assign import with_position
from pairweave.operators.components import connected_components
from pairweave.operators.edges import degrees
from pairweave.operators.rounds import SMALL_GRAPH, follow_to_roots, is_empty, per_component
from pairweave.operators.skew import label_ends
from pairweave.runtime import cut, materialised

#: Cells that one task holds at most; larger components are solved level by level.
COMPONENT_EDGES = 200_000
#: Share of a large component's cells that the next level is tried with.
LEVEL = 0.25


def _agglomerate(n: int, a: list[int], b: list[int], d: list[float]) -> list[tuple[float, int, int]]:
    """Merges ``(value, row, column)`` of one component; vertex i is node i, the k-th merge makes node n + k.

    Cells live in one dict per node; stale heap entries are recognised by a dead end. The order of cells is total
    (value, row, column), so the result doesn't depend on how the heap arranges them.
    """
    cells: dict[int, dict[int, float]] = {}
    heap = []
    for x, y, v in zip(a, b, d):
        lo, hi = (x, y) if x < y else (y, x)
        cells.setdefault(lo, {})[hi] = v
        cells.setdefault(hi, {})[lo] = v
        heap.append((v, lo, hi))
    heapq.heapify(heap)
    merges = []
    while heap:
        v, lo, hi = heapq.heappop(heap)
        if lo not in cells or hi not in cells:
            continue
        new = n + len(merges)
        merges.append((v, lo, hi))
        one, two = cells.pop(lo), cells.pop(hi)
        one.pop(hi, None)
        two.pop(lo, None)
        joint = {}
        for other in one.keys() & two.keys():
            joint[other] = w = max(one[other], two[other])
            cells[other][new] = w
            heapq.heappush(heap, (w, other, new))
        for gone, row in ((lo, one), (hi, two)):
            for other in row:
                cells[other].pop(gone, None)
        cells[new] = joint
    return merges


def _key_of(node: int, key) -> tuple:
    return (0.0, float(node)) if key is None else tuple(key)


def _component(pdf: pd.DataFrame) -> list[tuple]:
    """``(node, into, key)`` for the nodes of one component that merge, by its cells ``(a, b, d, ka, kb)``."""
    keys: dict[int, tuple] = {}
    for node, key in (("a", "ka"), ("b", "kb")):
        for x, k in zip(pdf[node].tolist(), pdf[key].tolist()):
            if x not in keys:
                keys[x] = _key_of(x, k)
    nodes = sorted(keys, key=keys.get)
    local = {x: i for i, x in enumerate(nodes)}
    n = len(nodes)
    merges = _agglomerate(n, [local[x] for x in pdf["a"].tolist()], [local[x] for x in pdf["b"].tolist()], pdf["d"].tolist())
    parts: list[list[int]] = [[x] for x in nodes]
    made = [keys[x] for x in nodes]
    top = set()
    for v, lo, hi in merges:
        parts.append(parts[lo] + parts[hi])
        made.append((1.0, v, *made[lo]))
        top -= {lo, hi}
        top.add(len(parts) - 1)
        parts[lo] = parts[hi] = []
    return [(x, min(parts[t]), list(made[t])) for t in sorted(top) for x in parts[t]]


def _oldest_first(pdf: pd.DataFrame) -> list[tuple]:
    """``(node, into, key)`` for the merges in which the nodes ``a`` of one component of equal cells come first.

    ``pdf`` has every cell ``(a, b, d, ka, kb)`` of the oldest nodes, in both directions where both ends are among
    them. A node's own cells say which merged nodes it has a cell with: those whose parts are all its neighbours.
    """
    value = float(pdf["d"].iloc[0])
    keys: dict[int, tuple] = {}
    near: dict[int, set[int]] = {}
    for a, b, ka, kb in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["ka"].tolist(), pdf["kb"].tolist()):
        near.setdefault(a, set()).add(b)
        keys.setdefault(a, _key_of(a, ka))
        keys.setdefault(b, _key_of(b, kb))
    owner: dict[int, int] = {}
    made: list[tuple[tuple, list[int]]] = []
    for x in sorted(near, key=keys.get):
        if x in owner:
            continue
        free = [y for y in near[x] if y not in owner]
        if free:
            other = [min(free, key=keys.get)]
        else:
            fits = [m for m in {owner[y] for y in near[x]} if made[m][1] and near[x].issuperset(made[m][1])]
            if not fits:
                continue
            oldest = min(fits, key=lambda m: made[m][0])
            other = made[oldest][1]
            made[oldest] = (made[oldest][0], [])
        members = [x, *other]
        for y in members:
            owner[y] = len(made)
        made.append(((1.0, value, *keys[x]), members))
    return [(y, min(members), list(key)) for key, members in made for y in members]


_MOVED = "node long, into long, key array<double>"


def _placed(cells: DataFrame, small_graph: int) -> DataFrame:
    """``(comp, a, b, d)``: cells with the component they are in."""
    roots = connected_components(cells.select(F.col("a").alias("src"), F.col("b").alias("dst")), small_graph)
    return cut(cells.join(roots.select(F.col("id").alias("a"), F.col("root").alias("comp")), "a").select("comp", "a", "b", "d"))


def _with_keys(cells: DataFrame, keys: DataFrame | None) -> DataFrame:
    if keys is None:
        none = F.lit(None).cast("array<double>")
        return cells.select("comp", "a", "b", "d", none.alias("ka"), none.alias("kb"))
    ka, kb = keys.select(F.col("node").alias("a"), F.col("key").alias("ka")), keys.select(F.col("node").alias("b"), F.col("key").alias("kb"))
    return cells.join(ka, "a", "left").join(kb, "b", "left").select("comp", "a", "b", "d", "ka", "kb")


def _level(cells: DataFrame, limit: int, small_graph: int) -> tuple[DataFrame | None, DataFrame | None]:
    """What can be merged next: (cells in components of at most ``limit`` cells, larger components of equal cells).

    A component that is too large is tried again with the smallest part of its cells, down to a single distance.
    """
    ready, tied = None, None
    rest = _placed(cells, small_graph)
    while True:
        sizes = rest.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
        large = cut(sizes.filter(F.col("n") > limit))
        if is_empty(large):
            fits, more = rest, None
        else:
            fits = rest.join(large.select("comp"), "comp", "left_anti")
            equal = rest.join(large.filter("low = high").select("comp"), "comp", "left_semi")
            tied = equal if tied is None else tied.unionByName(equal)
            mixed = rest.join(large.filter("low < high").select("comp", "low", "high"), "comp")
            t = mixed.groupBy("comp", "low", "high").agg(F.percentile_approx("d", LEVEL, 1_000).alias("t"))
            t = t.select("comp", F.when(F.col("t") < F.col("high"), F.col("t")).otherwise(F.col("low")).alias("t"))
            more = cut(mixed.join(t, "comp").filter("d <= t").select("a", "b", "d"))
        ready = fits if ready is None else ready.unionByName(fits)
        if more is None or is_empty(more):
            return ready, tied
        rest = _placed(more, small_graph)


def _oldest_cells(tied: DataFrame, keys: DataFrame | None, limit: int) -> DataFrame:
    """``(comp, a, b, d, ka, kb)``: all cells of the oldest nodes ``a`` of every component, up to ``limit`` cells each.

    The oldest node always counts; if it alone has more cells, only the one to its oldest neighbour is needed.
    """
    keyed = cut(_with_keys(tied, keys))
    there, back = F.struct("a", "b", "ka", "kb"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("kb").alias("ka"), F.col("ka").alias("kb"))
    arcs = keyed.select("comp", "d", F.explode(F.array(there, back)).alias("_e")).select("comp", "d", "_e.*")
    age_a, age_b = (F.coalesce(k, F.array(F.lit(0.0), F.col(n).cast("double"))) for k, n in (("ka", "a"), ("kb", "b")))
    nodes = arcs.groupBy("comp", "a").agg(F.first(age_a).alias("age"), F.count(F.lit(1)).alias("n"), F.min_by("b", age_b).alias("nearest"))
    placed = cut(with_position(nodes, [F.asc("comp"), F.asc("age")], "before", weight="n"))
    begin = placed.groupBy("comp").agg(F.min("before").alias("begin"))
    taken = placed.join(begin, "comp").withColumn("end", F.col("before") - F.col("begin") + F.col("n"))
    taken = taken.filter((F.col("end") <= limit) | (F.col("before") == F.col("begin"))).select("comp", "a", F.when(F.col("end") > limit, F.col("nearest")).alias("only"))
    return arcs.join(taken, ["comp", "a"]).filter("only is null or b = only").select("comp", "a", "b", "d", "ka", "kb")


def _contracted(cells: DataFrame, moved: DataFrame) -> DataFrame:
    """Cells between what the ends have merged into: the largest of all cells of the parts, if none is missing."""
    weight = moved.groupBy("into").agg(F.count(F.lit(1)).alias("w"))
    to_a, to_b = moved.select(F.col("node").alias("a"), F.col("into").alias("ia")), moved.select(F.col("node").alias("b"), F.col("into").alias("ib"))
    met = cells.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"), "d").filter("x <> y")
    met = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n"))
    sized = met.join(weight.select(F.col("into").alias("a"), F.col("w").alias("wa")), "a", "left").join(weight.select(F.col("into").alias("b"), F.col("w").alias("wb")), "b", "left")
    return sized.filter(F.col("n") == F.coalesce("wa", F.lit(1)) * F.coalesce("wb", F.lit(1))).select("a", "b", "d")


def linkage_levels(cells: DataFrame, *, component_edges: int = COMPONENT_EDGES, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """``(node, root, key)`` for every vertex that ends up merged, from cells ``(a, b, d)`` between vertex ranks.

    ``root`` is the smallest rank of the cluster, ``key`` its age (see the module). Each level takes the components of
    at most ``component_edges`` cells, one grouped task each; larger ones are taken only up to the distance at which
    they fall into such components, and where a single distance holds too large a component together, its oldest nodes
    are merged first, as many as a task holds. Then cells are contracted, and the next level begins. Every level gives
    just the merges of the pair-by-pair order, so the result doesn't depend on ``component_edges``.
    """
    live = cut(cells.select("a", "b", "d"))
    keys: DataFrame | None = None
    steps: list[DataFrame] = []
    while not is_empty(live):
        ready, tied = _level(live, component_edges, small_graph)
        moved = per_component(_with_keys(ready, keys), _component, _MOVED)
        if tied is not None and not is_empty(tied):
            moved = moved.unionByName(per_component(_oldest_cells(tied, keys, component_edges), _oldest_first, _MOVED))
        moved = cut(moved)
        live = cut(_contracted(live, moved))
        made = moved.filter("node = into").select("node", "key")
        keys = cut(made if keys is None else made.unionByName(keys.join(moved.select("node"), "node", "left_anti")))
        steps.append(moved.filter("node <> into").select(F.col("node").alias("id"), F.col("into").alias("parent")))
    if keys is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"), F.array("d").alias("key"))
    forest = steps[0]
    for step in steps[1:]:
        forest = forest.unionByName(step)
    merged = follow_to_roots(forest) if len(steps) > 1 else forest.withColumnRenamed("parent", "root")
    whole = merged.select(F.col("id").alias("node"), "root").unionByName(keys.select("node", F.col("node").alias("root")))
    return whole.join(keys.select(F.col("node").alias("root"), "key"), "root").select("node", "root", "key")


def complete_linkage(edges: DataFrame, vertices: DataFrame, *, component_edges: int = COMPONENT_EDGES, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """``(id, cluster_key)`` of complete linkage over ``edges(src, dst, d)``; clusters sort by the key.

    Keys put the latest merge first, then unmerged vertices from the last to appear. Ties between pairs are resolved by
    first appearance. Clusters and their order are those of merging pair by pair, at any size; see
    :func:`linkage_levels`. An empty graph gives an empty result.
    """
    edges = materialised(edges)
    ranked = cut(with_position(vertices.select("id", "appear_key"), [F.asc("appear_key")], "rank").select("id", "rank"))
    labels = cut(ranked.select("id", F.col("rank").alias("c")).join(degrees(edges), "id"))
    cells = label_ends(edges, labels, 2 * edges.count()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")
    merged = linkage_levels(cells, component_edges=component_edges, small_graph=small_graph).select(F.col("node").alias("rank"), "key")
    key = F.coalesce("key", F.array(F.lit(0.0), F.col("rank").cast("double")))
    # ages never begin like one another, so signs reverse their order; adding zero folds the two zeros
    return ranked.join(merged, "rank", "left").select("id", F.transform(key, lambda x: -x + F.lit(0.0)).alias("cluster_key"))
