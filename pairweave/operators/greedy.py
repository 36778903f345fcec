"""The greedy family: seeds by a processing order, then attachment.

Greedy incremental, closest-seed and set-cover clustering all choose the same kind of seeds: the lexicographically
first maximal independent set of the graph under a processing order. They differ in that order and in the seed that
the other objects join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairweave.operators.edges import degrees
from pairweave.operators.rounds import SMALL_GRAPH
from pairweave.operators.skew import heavy_split_join, label_ends
from pairweave.runtime import cut, derived, materialised


def keyed_arcs(edges: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """Directed entries ``(src, dst, ks, kd, ...)`` with the processing keys of both ends."""
    edges = materialised(edges)
    labels = cut(vertices.select("id", F.col(key).alias("c")).join(degrees(edges), "id"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    keyed = label_ends(edges, labels, 2 * edges.count())
    there = F.struct("src", "dst", F.col("a").alias("ks"), F.col("b").alias("kd"))
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("b").alias("ks"), F.col("a").alias("kd"))
    return keyed.select(F.explode(F.array(there, back)).alias("_e"), *rest).select("_e.*", *rest)


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Seeds of a small residual graph, by one scan in rank order."""
    neighbours: dict = {}
    for s, d in zip(pdf["rs"].tolist(), pdf["rd"].tolist()):
        neighbours.setdefault(s, []).append(d)
    names = dict(zip(pdf["rs"].tolist(), pdf["src"].tolist()))
    covered: set = set()
    seeds = []
    for v in sorted(neighbours):
        if v not in covered:
            seeds.append(names[v])
            covered.update(neighbours[v])
    return pd.DataFrame({"id": pd.Series(seeds, dtype=pdf["src"].dtype)})


def first_independent_set(arcs: DataFrame, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """Seeds ``(id)`` among the endpoints of ``(src, dst, ks, kd)``.

    In each round every vertex whose key is below those of all its live neighbours becomes a seed, and its
    neighbours are ruled out. Rounds end when no live entry is left, or when at most ``small_graph`` are, which one
    task then scans in order. Keys must be unique and sortable.
    """
    arcs = materialised(arcs, "src", "dst", "ks", "kd")
    found: list[DataFrame] = []
    while True:
        n = arcs.count()
        if not n:
            break
        if n <= small_graph:
            rank = F.dense_rank()
            ranked = arcs.select("src", rank.over(Window.orderBy("ks")).alias("rs"), "kd").select("src", "rs", rank.over(Window.orderBy("kd")).alias("rd"))
            found.append(ranked.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda pdf: _scan(pdf), f"id {arcs.schema['src'].dataType.simpleString()}"))
            break
        best = cut(arcs.groupBy(F.col("src").alias("id")).agg(F.min("kd").alias("low"), F.first("ks").alias("ks"), F.count(F.lit(1)).alias("degree")))
        first = derived(best, F.col("id").alias("src"), (F.col("ks") < F.col("low")).alias("seed"), "degree")
        seeds = best.filter(F.col("ks") < F.col("low")).select("id")
        ruled_out = heavy_split_join(arcs, first, "src", "degree", n).filter("seed").select(F.col("dst").alias("id")).distinct()
        gone = seeds.unionByName(ruled_out).withColumn("gone", F.lit(True))
        live = cut(best.select("id", "degree").join(gone, "id", "left").select("id", "degree", F.col("gone").isNull().alias("c")))
        rest = cut(label_ends(arcs, live, n).filter("a and b").select("src", "dst", "ks", "kd"))
        # a live vertex that has lost its last live neighbour is a seed, too
        bare = live.filter("c").select("id").join(rest.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        found += [seeds, cut(bare)]
        arcs = rest
    if not found:
        return arcs.select(F.col("src").alias("id"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _attached(arcs: DataFrame, vertices: DataFrame, key: str, choose, small_graph: int) -> DataFrame:
    """``(id, cluster_key)``: the key of the seed that each vertex is or joins; ``choose`` orders adjacent seeds."""
    arcs = cut(arcs)
    seeds = cut(first_independent_set(arcs, small_graph).withColumn("_seed", F.lit(True)))
    marked = vertices.select("id", F.col(key).alias("own")).join(seeds, "id", "left")
    degree = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    ends = seeds.join(degree, "id").select(F.col("id").alias("dst"), "degree")
    joined = heavy_split_join(arcs, ends, "dst", "degree", arcs.count()).filter(F.col("kd") < F.col("ks"))
    picks = joined.groupBy(F.col("src").alias("id")).agg(F.min_by("kd", choose).alias("joined"))
    return marked.join(picks, "id", "left").select("id", F.when(F.col("_seed"), F.col("own")).otherwise(F.coalesce("joined", "own")).alias("cluster_key"))


def greedy_incremental(edges: DataFrame, vertices: DataFrame, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """In processing order an unassigned object becomes a seed and takes its unassigned neighbours."""
    arcs = keyed_arcs(edges.select("src", "dst"), vertices, "proc_key")
    return _attached(arcs, vertices, "proc_key", F.col("kd"), small_graph)


def closest_seed(edges: DataFrame, vertices: DataFrame, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """As the greedy incremental method, but an object joins the closest seed before it; ties go to the seed that
    appeared first, whatever the processing order."""
    arcs = keyed_arcs(edges.select("src", "dst", "d"), vertices, "proc_key")
    arcs = cut(arcs)
    degree = arcs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    appeared = vertices.join(degree, "id").select(F.col("id").alias("dst"), "appear_key", "degree")
    return _attached(heavy_split_join(arcs, appeared, "dst", "degree", arcs.count()), vertices, "proc_key", F.struct("d", "appear_key"), small_graph)


def set_cover(edges: DataFrame, vertices: DataFrame, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """As the greedy incremental method, in the order of degree, largest first, then of processing."""
    ordered = cut(
        vertices.join(degrees(edges), "id", "left").select("id", "appear_key", F.struct((-F.coalesce("degree", F.lit(0))).alias("neg_degree"), F.col("proc_key").alias("proc_key")).alias("cover_key"))
    )
    return _attached(keyed_arcs(edges.select("src", "dst"), ordered, "cover_key"), ordered, "cover_key", F.col("kd"), small_graph)
