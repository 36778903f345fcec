"""Consolidating pairwise matches into groups: connected components by reduction to a core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.operators.components import connected_components
from pairweave.operators.edges import symmetrize
from pairweave.operators.rounds import SMALL_GRAPH, follow_to_roots, is_empty
from pairweave.operators.skew import heavy_split_join
from pairweave.runtime import cut
from pairweave.sources.tables import table


def _neighbourhoods(edges: DataFrame) -> DataFrame:
    """``(id, degree, low, high)``: for a vertex of degree one or two, its neighbours."""
    return symmetrize(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.min("dst").alias("low"), F.max("dst").alias("high"))


def strip_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove vertices of degree one: (edges that are left, removed ``(id, parent)``).

    Of two leaves joined to each other the smaller stays.
    """
    leaves = _neighbourhoods(edges).filter("degree = 1").select("id", F.col("low").alias("other"))
    # a leaf names its only edge, so edges meet leaves on both ends at once and a hub never gathers its edges
    named = leaves.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), "id").groupBy("src", "dst").agg(F.max("id").alias("id"))
    named = cut(named)
    gone = named.select("id", F.when(F.col("id") == F.col("src"), F.col("dst")).otherwise(F.col("src")).alias("parent"))
    return edges.join(named.select("src", "dst"), ["src", "dst"], "left_anti"), gone


def rank_chains(chain: DataFrame) -> DataFrame:
    """``(id, end, low)`` for every vertex of ``chain(id, low, high)``, the vertices of degree two: ``end`` is a vertex
    outside that its chain leads to (one row per direction), or null on a cycle, whose smallest vertex is ``low``.

    List ranking on directed entries: the entry into a vertex from one neighbour is followed by the entry from that
    vertex into its other neighbour. Pointers double in every round, so a chain of n vertices takes log2(n) rounds;
    only entries that haven't reached their end take part.
    """
    v = chain.select("id", F.explode(F.array(F.struct(F.col("low").alias("via"), F.col("high").alias("next")), F.struct(F.col("high").alias("via"), F.col("low").alias("next")))).alias("e"))
    state = cut(v.select(F.col("e.via").alias("via"), "id", F.col("id").alias("from"), F.col("e.next").alias("to"), F.col("id").alias("least"), F.lit(False).alias("done")))
    waiting, settled = state, None
    before = None
    while True:
        ahead = state.select(F.col("via").alias("_v"), F.col("id").alias("_i"), F.col("from").alias("_from"), F.col("to").alias("_to"), F.col("least").alias("_least"), F.col("done").alias("_done"))
        stepped = waiting.join(ahead, (F.col("from") == F.col("_v")) & (F.col("to") == F.col("_i")), "left").select(
            "via",
            "id",
            F.coalesce("_from", "from").alias("from"),
            F.coalesce("_to", "to").alias("to"),
            F.least("least", F.coalesce("_least", "least")).alias("least"),
            (F.col("_v").isNull() | F.col("_done")).alias("done"),
            (F.col("_least") < F.col("least")).alias("lower"),
        )
        stepped = cut(stepped)
        counts = stepped.agg(F.count_if(~F.col("done")).alias("open"), F.count_if(~F.col("done") & F.col("lower")).alias("lower")).first()
        done = stepped.filter("done").drop("lower")
        settled = done if settled is None else settled.unionByName(done)
        waiting = stepped.filter("not done").drop("lower")
        # open entries dwindle as long as a chain has some; once they don't, only cycles are left, whose minimum
        # is complete when it no longer falls
        if not counts["open"] or (counts["open"] == before and not counts["lower"]):
            cycles = waiting.select("id", F.lit(None).cast(chain.schema["id"].dataType).alias("end"), F.col("least").alias("low"))
            return settled.select("id", F.col("to").alias("end"), F.col("least").alias("low")).unionByName(cycles)
        before = counts["open"]
        state = settled.unionByName(waiting)


def compress_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace each chain of degree-two vertices by one edge between its ends: (edges, removed ``(id, parent)``)."""
    chain = cut(_neighbourhoods(edges).filter("degree = 2").select("id", "low", "high"))
    if is_empty(chain):
        return edges, chain.select("id", F.col("low").alias("parent")).limit(0)
    ends = rank_chains(chain).groupBy("id").agg(F.min("end").alias("a"), F.max("end").alias("b"), F.min("low").alias("low"))
    ends = cut(ends)
    removed = ends.select("id", F.coalesce("a", "low").alias("parent")).filter("id <> parent")
    sides = chain.select("id", F.explode(F.array("low", "high")).alias("other")).select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"))
    rest = edges.join(sides, ["src", "dst"], "left_anti")
    bridges = ends.filter("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return rest.unionByName(bridges).distinct(), removed


def match_groups(pairs: DataFrame, *, small_graph: int = SMALL_GRAPH, least_gain: float = 0.1) -> DataFrame:
    """``(group_id, object)`` for every object of ``pairs(a, b)``: the smallest object linked to it, directly or not.

    Vertices of degree one are stripped and chains of degree two compressed, round after round, each vertex noting a
    vertex it hangs on; once a round removes less than ``least_gain`` of the edges, the reduced core is solved, and
    the notes are followed back. Repeated pairs, either order, and pairs of an object with itself or with null count
    as in a simple graph: once, or not at all. An empty table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    edges = cut(pairs.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct())
    notes: list[DataFrame] = []
    size = edges.count()
    while size:
        left, gone = strip_leaves(edges)
        left, removed = compress_chains(cut(left))
        notes += [gone, removed]
        edges = cut(left)
        was, size = size, edges.count()
        if size > (1 - least_gain) * was:
            break
    core = connected_components(edges, small_graph).select("id", F.col("root").alias("parent")).filter("id <> parent")
    forest = core
    for n in notes:
        forest = forest.unionByName(n)
    labels = follow_to_roots(forest)
    total = labels.count()
    groups = labels.groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).select("root", F.least("least", "root").alias("group_id"), "n")
    groups = cut(groups)
    members = heavy_split_join(labels, groups, "root", "n", total).select("group_id", F.col("id").alias("object"))
    return members.unionByName(groups.select("group_id", F.col("root").alias("object")))


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "toy_ani", "id1", "id2", "tani")
    return rows.filter(F.col("tani").between(0.95, 1.0) & ~F.isnan("tani")).select(F.col("id1").alias("a"), F.col("id2").alias("b"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every object that has a match, with the smallest object of its group."""
    return match_groups(_matches(spark, folder))


def p3_moved(spark: SparkSession, folder: str) -> DataFrame:
    """Groups against the earlier assignment: objects per group, earlier clusters they come from, unassigned ones."""
    old = table(spark, folder, "toy_clusters", "object", "cluster").filter("object is not null").groupBy("object").agg(F.min("cluster").alias("cluster"))
    both = p3_found(spark, folder).join(old, "object", "left")
    per = both.groupBy("group_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("group_id").agg(F.sum("n").alias("n_objects"), F.count("cluster").alias("n_old_clusters"), F.coalesce(F.sum(F.when(F.col("cluster").isNull(), F.col("n"))), F.lit(0)).alias("n_unassigned"))


QUERIES = {"p3_found": p3_found, "p3_moved": p3_moved}

_REACH = """
with recursive e as (
  select id1 as a, id2 as b from toy_ani where tani between 0.95 and 1 and not isnan(tani) and id1 <> id2
  union select id2, id1 from toy_ani where tani between 0.95 and 1 and not isnan(tani) and id1 <> id2
), reach(v, root) as (
  select a, a from e union select reach.v, e.b from reach join e on e.a = reach.root
), g as (select min(root) as group_id, v as object from reach group by v)
"""
ORACLE = {
    "p3_found": _REACH + "select group_id, object from g",
    "p3_moved": _REACH
    + """, o as (select object, min(cluster) as cluster from toy_clusters where object is not null group by 1)
select group_id, count(*) as n_objects, count(distinct o.cluster) as n_old_clusters, count(*) filter (where o.cluster is null) as n_unassigned
from g left join o using (object) group by 1""",
}
