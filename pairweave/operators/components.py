"""Single linkage: connected components of the canonical graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.operators.edges import symmetrize
from pairweave.operators.rounds import SMALL_GRAPH, follow_to_roots, is_empty
from pairweave.operators.skew import heavy_split_join, label_ends
from pairweave.runtime import cut, materialised


def _union_find(edges: pd.DataFrame) -> pd.DataFrame:
    codes, names = pd.factorize(pd.concat([edges["src"], edges["dst"]], ignore_index=True))
    up = list(range(len(names)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    half = len(edges)
    for a, b in zip(codes[:half].tolist(), codes[half:].tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            up[ra] = rb
    return pd.DataFrame({"id": names, "root": [names[find(x)] for x in range(len(names))]})


def connected_components(edges: DataFrame, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """``(id, root)`` for every endpoint of ``(src, dst)``; ``root`` is one member of the component.

    Each round hooks every vertex to the smallest name among itself and its neighbours, follows the hooks to their
    roots and contracts the edges to pairs of roots, so that the edge table shrinks until it is empty. Once at most
    ``small_graph`` edges are left, one task finishes them; 0 switches that off. An empty edge table gives an empty
    result.
    """
    edges = materialised(edges, "src", "dst")
    forest: DataFrame | None = None
    id_type = edges.schema["src"].dataType.simpleString()
    while True:
        n_edges = edges.count()
        if n_edges <= small_graph:
            last = edges.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda pdf: _union_find(pdf), f"id {id_type}, root {id_type}")
            if forest is None:
                return last
            forest = forest.unionByName(last.select("id", F.col("root").alias("parent")))
            break
        if is_empty(edges):
            break
        hooks = cut(symmetrize(edges).groupBy("src").agg(F.min("dst").alias("best"), F.count(F.lit(1)).alias("degree")))
        roots = follow_to_roots(hooks.select(F.col("src").alias("id"), F.least("src", "best").alias("parent")))
        labels = cut(roots.join(hooks.select(F.col("src").alias("id"), "degree"), "id").select("id", "degree", F.col("root").alias("c")))
        contracted = label_ends(edges, labels, 2 * n_edges).filter("a <> b")
        edges = cut(contracted.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        step = roots.filter("id <> root").select("id", F.col("root").alias("parent"))
        forest = step if forest is None else forest.unionByName(step)
    if forest is None:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("root"))
    # a root of one round may be hooked in a later one, so ids are unique only among the hooked
    forest = forest.filter(F.col("id") != F.col("parent"))
    labels = follow_to_roots(forest)
    tops = labels.select(F.col("root").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return labels.unionByName(tops)


def single_linkage(edges: DataFrame, vertices: DataFrame, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """``(id, cluster_key)``: the component's smallest ``proc_key``. Vertices without an edge stand alone."""
    roots = connected_components(edges, small_graph)
    labelled = cut(vertices.select("id", "proc_key").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    keys = cut(labelled.groupBy("root").agg(F.min("proc_key").alias("cluster_key"), F.count(F.lit(1)).alias("n")))
    return heavy_split_join(labelled, keys, "root", "n", labelled.count()).select("id", "cluster_key")


def single_linkage_merges(edges: DataFrame) -> DataFrame:
    """``(step, src, dst, d)``: the merges of single linkage over ``edges(src, dst, d)``, numbered from the nearest.

    They are the edges of the smallest spanning forest in the order (d, src, dst). In each round every component takes
    its first edge that leaves it, components so joined become one, and of the edges between two components only the
    first stays; so the edge table shrinks, and at least halves its components, until it is empty. Two components that
    take the same edge have it once. An empty graph gives an empty result.
    """
    from pairweave.operators.assign import with_position

    key = F.struct("d", "src", "dst").alias("key")
    live = cut(edges.select("src", "dst", "d").select(F.col("src").alias("a"), F.col("dst").alias("b"), key))
    taken: list[DataFrame] = []
    while not is_empty(live):
        first = cut(live.select("key", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e")).groupBy("e.id").agg(F.min(F.struct("key", F.col("e.to").alias("to"))).alias("m"), F.count(F.lit(1)).alias("n")))
        taken.append(first.select("m.key").distinct())
        # two components that took the same edge point at each other; the smaller of them is the root
        back = first.select(F.col("id").alias("to"), F.col("m.key").alias("_back"))
        hooks = first.select("id", "n", F.col("m.to").alias("to"), F.col("m.key").alias("_key")).join(back, "to", "left")
        mutual = (F.col("_back") == F.col("_key")) & (F.col("id") < F.col("to"))
        roots = follow_to_roots(hooks.select("id", F.when(mutual, F.col("id")).otherwise(F.col("to")).alias("parent")))
        labels = cut(roots.join(first.select("id", F.col("n").alias("degree")), "id").select("id", "degree", F.col("root").alias("c")))
        ends = label_ends(live.select(F.col("a").alias("src"), F.col("b").alias("dst"), "key"), labels, 2 * live.count())
        live = cut(ends.filter("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("key").alias("key")).toDF("a", "b", "key"))
    if not taken:
        return edges.select(F.lit(0).cast("long").alias("step"), "src", "dst", "d").limit(0)
    tree = taken[0]
    for more in taken[1:]:
        tree = tree.unionByName(more)
    return with_position(tree, [F.asc("key")], "step").select("step", "key.src", "key.dst", "key.d")
