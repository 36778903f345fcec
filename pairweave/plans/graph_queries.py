"""Registered queries of the clustering engine over the pair tables, with equivalent SQL."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.functions.transforms import range_predicate, to_distance, usable
from pairweave.operators import assign, components, edges
from pairweave.operators.compare import pairs_to_numeric, partition_similarity
from pairweave.operators.leiden import cpm_quality
from pairweave.plans.cluster import ClusterOptions, build_graph, cluster, keyed_clusters
from pairweave.runtime import cut, ensure_checkpoint_dir
from pairweave.sources.pairs import edge_lines, read_objects, read_pairs
from pairweave.sources.tables import table

#: The cut of the pair table that the clustering queries use.
LOW, HIGH = 0.95, 1.0
#: Cells that one task may hold in cluster_complete_rounds; all components that are larger go through several levels.
ROUNDS_HOLD = 24
#: Distances at which merges are counted.
CUTS = (0.0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "toy_ani")


def _options(**named) -> ClusterOptions:
    base = {"id_cols": ("id1", "id2"), "distance_col": "tani", "kind": "similarity", "minimum": {"tani": LOW}, "maximum": {"tani": HIGH}}
    return ClusterOptions(**(base | named))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return edges.surviving_pairs(_pairs(spark, folder), ("id1", "id2"), "tani", kind="similarity", minimum={"tani": LOW}, maximum={"tani": HIGH}, order=F.col("row_id"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return edges.canonical_edges(_rows(spark, folder))


def pairs_transform_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity to distance."""
    rows = _pairs(spark, folder).filter(usable(F.col("tani")))
    return rows.select("row_id", to_distance(F.col("tani"), "similarity").alias("d"))


def pairs_transform_identity(spark: SparkSession, folder: str) -> DataFrame:
    """A column taken as the distance that it is."""
    rows = _pairs(spark, folder).filter(usable(F.col("cov")))
    return rows.select("row_id", to_distance(F.col("cov"), "distance").alias("d"))


def pairs_transform_percent(spark: SparkSession, folder: str) -> DataFrame:
    """Percentage to distance."""
    rows = table(spark, folder, "vir61_ani").filter(usable(F.col("ani")) & (F.col("ani") > 1))
    return rows.select("id1", "id2", to_distance(F.col("ani"), "percent").alias("d"))


def _filtered(spark: SparkSession, folder: str, minimum=None, maximum=None) -> DataFrame:
    return _pairs(spark, folder).filter(range_predicate(minimum, maximum)).select("row_id")


def pairs_drop_self(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that relate two different objects."""
    rows = edges.surviving_pairs(_pairs(spark, folder), ("id1", "id2"), "tani", order=F.col("row_id"))
    return rows.select(F.col("ord").alias("row_id"))


def edges_symmetrize(spark: SparkSession, folder: str) -> DataFrame:
    """Both directions of every edge."""
    return edges.symmetrize(_edges(spark, folder))


def edges_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """One edge per pair, with its smallest distance."""
    return _edges(spark, folder)


def edges_unfiltered(spark: SparkSession, folder: str) -> DataFrame:
    """One edge per pair of the whole table, with its smallest distance."""
    return edges.canonical_edges(edges.surviving_pairs(_pairs(spark, folder), ("id1", "id2"), "tani", kind="similarity"))


def vertices_first_appearance(spark: SparkSession, folder: str) -> DataFrame:
    """Objects with the row and the column in which they first appear."""
    return edges.vertices(_rows(spark, folder)).select(F.col("id").alias("object"), F.col("appear_key.ord").alias("first_row"), F.col("appear_key.pos").cast("long").alias("first_col"))


def vertex_degree(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours per object."""
    return edges.degrees(_edges(spark, folder)).withColumnRenamed("id", "object")


def edge_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, edges and directed entries."""
    return edges.edge_counts(_rows(spark, folder), _edges(spark, folder))


def distance_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Directed entries by distance."""
    return edges.distance_histogram(_edges(spark, folder)).select("bin", "n")


def _clustered(spark: SparkSession, folder: str, **named) -> DataFrame:
    return cluster(_pairs(spark, folder), order=F.col("row_id"), options=_options(**named))


def _assignment(spark: SparkSession, folder: str, **named) -> DataFrame:
    return _clustered(spark, folder, **named).select("object", "cluster")


def cluster_leiden(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of the constant Potts model; the weight of an edge is its similarity."""
    return _assignment(spark, folder, algo="leiden")


def leiden_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of the communities against single objects and whole components."""
    options = _options(algo="leiden").resolve(_pairs(spark, folder).columns)
    graph = build_graph(_pairs(spark, folder), options, order=F.col("row_id"))
    found = keyed_clusters(graph, options).select("id", F.to_json("cluster_key").alias("community"))
    parts = keyed_clusters(graph, _options(algo="single")).select("id", F.to_json("cluster_key").alias("community"))
    a, b = cpm_quality(graph.edges, found, 0.7), cpm_quality(graph.edges, parts, 0.7).withColumnRenamed("quality", "quality_of_components")
    return a.unionByName(b, allowMissingColumns=True).agg(F.round(F.max("quality"), 6).alias("quality"), F.round(F.max("quality_of_components"), 6).alias("quality_of_components"))


def cluster_leiden_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The same by distributed rounds throughout, whatever the size of the components."""
    return _assignment(spark, folder, algo="leiden", component_edges=0)


def leiden_holds(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the communities of the distributed rounds: objects, those that would gain by moving to a
    neighbouring community, pairs of communities that would gain by merging, and communities in several pieces."""
    options = _options(algo="leiden", component_edges=0).resolve(_pairs(spark, folder).columns)
    graph = build_graph(_pairs(spark, folder), options, order=F.col("row_id"))
    graph.edges, graph.vertices = cut(graph.edges), cut(graph.vertices)
    found = cut(keyed_clusters(graph, options).select("id", F.to_json("cluster_key").alias("community")))
    arcs = edges.symmetrize(graph.edges).select("src", "dst", (1.0 - F.col("d")).alias("w"))
    a, b = found.toDF("src", "a"), found.toDF("dst", "b")
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    placed = cut(arcs.join(a, "src").join(b, "dst"))
    sums = placed.groupBy("src", "a", "b").agg(F.sum("w").alias("w")).join(sizes.toDF("b", "nb"), "b")
    gain = F.col("w") - 0.7 * (F.col("nb") - (F.col("a") == F.col("b")).cast("int"))
    per = sums.groupBy("src", "a").agg(F.max(gain).alias("best"), F.max(F.when(F.col("a") == F.col("b"), gain)).alias("now")).join(sizes.toDF("a", "na"), "a")
    moves = per.filter(F.greatest("best", F.lit(0.0)) > F.coalesce("now", -0.7 * (F.col("na") - 1)) + 1e-6).agg(F.count(F.lit(1)).alias("n_gaining_moves"))
    between = placed.filter("a < b").groupBy("a", "b").agg(F.sum("w").alias("w")).join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    merges = between.filter(F.col("w") > 0.7 * F.col("na") * F.col("nb") + 1e-6).agg(F.count(F.lit(1)).alias("n_gaining_merges"))
    parts = components.connected_components(placed.filter("a = b and src < dst").select("src", "dst")).join(found, "id")
    split = parts.groupBy("community").agg(F.countDistinct("root").alias("k")).filter("k > 1").agg(F.count(F.lit(1)).alias("n_split"))
    out = found.agg(F.count(F.lit(1)).alias("n_objects"))
    for part in (moves, merges, split):
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in ("n_objects", "n_gaining_moves", "n_gaining_merges", "n_split")])


def _objects(spark: SparkSession, folder: str) -> DataFrame:
    firsts = table(spark, folder, "toy_ids", "id", "rec_id").filter("id is not null").groupBy("id").agg(F.min("rec_id").alias("first"))
    return assign.with_position(firsts, [F.asc("first")], "gi").select(F.col("id").alias("object"), "gi")


def cluster_with_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Single linkage of the listed objects, in the order of their first record."""
    out = cluster(_pairs(spark, folder), order=F.col("row_id"), objects=_objects(spark, folder), options=_options(missing="drop"))
    return out.select("object", "cluster")


def cluster_with_objects_cdhit(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy incremental clustering in the order of the listed objects."""
    out = cluster(_pairs(spark, folder), order=F.col("row_id"), objects=_objects(spark, folder), options=_options(algo="cd-hit", missing="drop"))
    return out.select("object", "cluster")


def _numbered_objects(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _pairs(spark, folder)
    both = pairs.select(F.explode(F.array(F.struct(F.col("idx1").alias("gi"), F.col("id1").alias("object")), F.struct(F.col("idx2").alias("gi"), F.col("id2").alias("object")))).alias("x")).select("x.*")
    return both.filter("gi is not null and object is not null").groupBy("gi").agg(F.min("object").alias("object")).select("object", "gi")


def cluster_numeric_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Single linkage by object numbers, named and completed by the list."""
    out = cluster(_pairs(spark, folder), order=F.col("row_id"), objects=_numbered_objects(spark, folder), options=_options(id_cols=("idx1", "idx2"), numeric_ids=True, missing="drop"))
    return out.select("object", "cluster")


def cluster_representatives(spark: SparkSession, folder: str) -> DataFrame:
    """Single linkage with the first object of each cluster in place of its number."""
    return _assignment(spark, folder, representatives=True)


def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Objects per cluster."""
    return assign.cluster_sizes(_assignment(spark, folder))


def cluster_count(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters, clusters of one, objects; listed objects without a pair are clusters of one."""
    return assign.cluster_count(cluster_with_objects(spark, folder))


def partition_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of single linkage with the earlier assignment."""
    old = table(spark, folder, "toy_clusters", "object", "cluster").filter("object is not null and cluster is not null")
    return partition_similarity(_assignment(spark, folder), old)


def pairs_to_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Names replaced by list positions."""
    pairs = _pairs(spark, folder).select("row_id", "id1", "id2", "tani")
    return pairs_to_numeric(pairs, _objects(spark, folder), ("id1", "id2")).select("row_id", "id1", "id2")


def vir61_single(spark: SparkSession, folder: str) -> DataFrame:
    """Single linkage of the genomes whose similarity is given as a share."""
    options = ClusterOptions(id_cols=("id2", "id1"), distance_col="ani", kind="similarity", minimum={"ani": 0.95}, maximum={"ani": 1.0})
    return cluster(table(spark, folder, "vir61_ani"), options=options).select("object", "cluster")


def vir61_percent(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy set cover of the genomes whose similarity is given in percent, by name order."""
    options = ClusterOptions(algo="set-cover", id_cols=("id1", "id2"), distance_col="ani", kind="percent", minimum={"ani": 95.0}, maximum={"ani": 100.0})
    rows = table(spark, folder, "vir61_ani")
    return cluster(rows, order=F.struct(F.least("id1", "id2"), F.greatest("id1", "id2")), options=options).select("object", "cluster")


def load_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the table, rows that survive, edges and directed entries."""
    return edges.load_counts(_pairs(spark, folder), _rows(spark, folder), _edges(spark, folder))


def distance_histogram_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Directed entries by distance over the whole table, without a cut."""
    return edges.distance_histogram(edges_unfiltered(spark, folder)).select("bin", "n")


def _genomes(spark: SparkSession, folder: str) -> DataFrame:
    """The genome pairs with every similarity as a share, whatever scale it is given in."""
    rows = table(spark, folder, "vir61_ani", "id1", "id2", "ani")
    return rows.select("id1", "id2", F.when(F.col("ani") > 1, F.col("ani") * 0.01).otherwise(F.col("ani")).alias("share"))


def vir61_whole(spark: SparkSession, folder: str, algo: str) -> DataFrame:
    """Clusters of all genomes, in the order of their pairs' names."""
    options = ClusterOptions(algo=algo, id_cols=("id1", "id2"), distance_col="share", kind="similarity", minimum={"share": 0.95}, maximum={"share": 1.0})
    rows = _genomes(spark, folder)
    return cluster(rows, order=F.struct(F.least("id1", "id2"), F.greatest("id1", "id2")), options=options).select("object", "cluster")


def merge_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The merges of single linkage, nearest first."""
    return components.single_linkage_merges(_edges(spark, folder)).select("step", "src", "dst", "d")


def merge_heights(spark: SparkSession, folder: str) -> DataFrame:
    """Merges of single linkage up to each of some distances: objects less clusters at that cut."""
    tree = components.single_linkage_merges(_edges(spark, folder))
    cuts = F.explode(F.array(*[F.lit(x) for x in CUTS])).alias("cut")
    return tree.select("d", cuts).filter("d <= cut").groupBy("cut").agg(F.count(F.lit(1)).alias("n_merges"))


# Text: the tables are written as the delimited files that a pair table comes as, into the shared folder, and read back.


def _written(df: DataFrame, separator: str) -> str:
    """The rows, in the order they come in, as text files with a header; null is an empty field."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/text-{uuid.uuid4().hex}"
    df.write.option("header", True).option("sep", separator).option("nullValue", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pair table read from comma-separated text; rows without a number in tani are left out."""
    path = _written(_pairs(spark, folder).select("row_id", "id1", "id2", "tani", "cov"), ",")
    rows, _ = read_pairs(spark, path, id_cols=("id1", "id2"), distance_col="tani", filters=["row_id"], permissive=True)
    return rows.filter(usable(F.col("tani"))).select(F.col("row_id").cast("long").alias("row_id"), "id1", "id2", "tani")


def text_pairs_numeric(spark: SparkSession, folder: str) -> DataFrame:
    """The same with object numbers, from tab-separated text of the rows that have all of them, read strictly."""
    whole = _pairs(spark, folder).select("row_id", "idx1", "idx2", "tani").dropna(subset=["idx1", "idx2"]).filter("tani is not null")
    rows, _ = read_pairs(spark, _written(whole, "\t"), id_cols=("idx1", "idx2"), distance_col="tani", filters=["row_id"], numeric_ids=True)
    return rows.filter(usable(F.col("tani"))).select(F.col("row_id").cast("long").alias("row_id"), "idx1", "idx2", "tani")


def text_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Single linkage from text to assignment, rows in the order of their lines."""
    path = _written(_pairs(spark, folder).filter("id1 is not null and id2 is not null").orderBy("row_id").select("id1", "id2", "tani"), "\t")
    rows, order = read_pairs(spark, path, permissive=True)
    return cluster(rows, order=order, options=_options()).select("object", "cluster")


def text_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The list of objects from text, with their positions."""
    firsts = table(spark, folder, "toy_ids", "id", "rec_id").filter("id is not null").groupBy("id").agg(F.min("rec_id").alias("first"))
    path = _written(firsts.orderBy("first").select("id", "first"), "\t")
    return read_objects(spark, path)


def _placed(out: DataFrame) -> DataFrame:
    return assign.with_position(out, [F.asc("cluster_no"), F.asc("out_key")], "place").select("place", "object", "cluster")


def output_order(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the assignment file: by cluster, then by name."""
    return _placed(_clustered(spark, folder))


def output_order_listed(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the assignment file of listed objects, by cluster and then position, with representatives."""
    return _placed(cluster(_pairs(spark, folder), order=F.col("row_id"), objects=_objects(spark, folder), options=_options(missing="drop", representatives=True)))


def edge_dump(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the edge file in their order."""
    lines = edge_lines(_edges(spark, folder), edges.vertices(_rows(spark, folder)))
    return assign.with_position(lines, [F.asc("src"), F.asc("nearby")], "place").select("place", "line")


_ALGOS = {"single": "single", "cdhit": "cd-hit", "uclust": "uclust", "setcover": "set-cover", "complete": "complete"}

QUERIES = {
    "pairs_transform_similarity": pairs_transform_similarity,
    "pairs_transform_identity": pairs_transform_identity,
    "pairs_transform_percent": pairs_transform_percent,
    "pairs_filter_min": partial(_filtered, minimum={"ani": 0.9}),
    "pairs_filter_max": partial(_filtered, maximum={"cov": 0.4}),
    "pairs_filter_multi": partial(_filtered, minimum={"ani": 0.8, "cov": 0.5}, maximum={"cov": 0.9, "num_alns": 40}),
    "pairs_filter_tightest": partial(_filtered, minimum=[("ani", 0.5), ("ani", 0.85), ("ani", 0.7)], maximum=[("ani", 1.0), ("ani", 0.95)]),
    "pairs_drop_self": pairs_drop_self,
    "pairs_to_numbers": pairs_to_numbers,
    "edges_symmetrize": edges_symmetrize,
    "edges_canonical": edges_canonical,
    "edges_unfiltered": edges_unfiltered,
    "edge_counts": edge_counts,
    "vertices_first_appearance": vertices_first_appearance,
    "vertex_degree": vertex_degree,
    "distance_histogram": distance_histogram,
    **{f"cluster_{name}": partial(_assignment, algo=algo) for name, algo in _ALGOS.items()},
    # the distributed rounds throughout, whatever the size of the graph
    **{f"cluster_{name}_rounds": partial(_assignment, algo=algo, small_graph=0) for name, algo in _ALGOS.items() if algo != "complete"},
    "cluster_complete_rounds": partial(_assignment, algo="complete", component_edges=ROUNDS_HOLD),
    "cluster_leiden": cluster_leiden,
    "leiden_quality": leiden_quality,
    "cluster_leiden_rounds": cluster_leiden_rounds,
    "leiden_holds": leiden_holds,
    "cluster_representatives": cluster_representatives,
    "cluster_with_objects": cluster_with_objects,
    "cluster_with_objects_cdhit": cluster_with_objects_cdhit,
    "cluster_numeric_objects": cluster_numeric_objects,
    "cluster_sizes": cluster_sizes,
    "cluster_count": cluster_count,
    "partition_agreement": partition_agreement,
    "vir61_single": vir61_single,
    "vir61_percent": vir61_percent,
    "load_counts": load_counts,
    "distance_histogram_whole": distance_histogram_whole,
    "vir61_whole_single": partial(vir61_whole, algo="single"),
    "vir61_whole_setcover": partial(vir61_whole, algo="set-cover"),
    "vir61_whole_cdhit": partial(vir61_whole, algo="cd-hit"),
    "merge_tree": merge_tree,
    "merge_heights": merge_heights,
    "text_pairs": text_pairs,
    "text_pairs_numeric": text_pairs_numeric,
    "text_clusters": text_clusters,
    "text_objects": text_objects,
    "output_order": output_order,
    "output_order_listed": output_order_listed,
    "edge_dump": edge_dump,
}

# --- SQL ---------------------------------------------------------------------------------------------------------

_GRAPH = """
with recursive r as (select id1 as a, id2 as b, 1.0 - tani as d, row_id from toy_ani where tani between 0.95 and 1 and not isnan(tani) and id1 <> id2),
 e as (select least(a, b) as src, greatest(a, b) as dst, min(d) as d from r group by 1, 2),
 n as (select src, dst, d from e union all select dst, src, d from e),
 v as (select id, min(k) as k from (select a as id, row_id * 2 as k from r union all select b, row_id * 2 + 1 from r) group by 1)
"""


def _ranked(order: str, source: str = "v") -> str:
    return f""", o as (select id, k, row_number() over (order by {order}) as i from {source})"""


_REACH = """, reach(x, y) as (select id, id from v union select reach.x, n.dst from reach join n on n.src = reach.y)"""
_NUMBERED = """, sizes as (select key, count(*) as m from keyed group by 1), numbers as (select key, m, row_number() over (order by m desc, key) - 1 as cluster from sizes)"""
_OUT = " select id as object, cluster from keyed join numbers using (key)"

_SINGLE = _GRAPH + _ranked("k") + _REACH + """, keyed as (select x as id, min(o.i) as key from reach join o on o.id = reach.y group by 1)""" + _NUMBERED

_SEEDS = """, nb as (select o.i, list(p.i) as ns from o join n on n.src = o.id join o as p on p.id = n.dst group by 1),
 step(i, seeds) as (select 0::bigint, []::bigint[] union all
   select s.i + 1, case when list_has_any(s.seeds, coalesce(nb.ns, [])) then s.seeds else list_append(s.seeds, s.i + 1) end
   from step s join o on o.i = s.i + 1 left join nb on nb.i = o.i),
 seed as (select unnest(seeds) as i from (select seeds from step order by i desc limit 1))"""


def _attach(order: str) -> str:
    return f""", joins as (select o.id, arg_min(p.i, {order}) as key from o join n on n.src = o.id join o as p on p.id = n.dst join seed on seed.i = p.i where p.i < o.i and o.i not in (select i from seed) group by 1),
 keyed as (select o.id, case when o.i in (select i from seed) then o.i else joins.key end as key from o left join joins on joins.id = o.id)"""


_CDHIT = _GRAPH + _ranked("k") + _SEEDS + _attach("p.i") + _NUMBERED
_UCLUST = _GRAPH + _ranked("k") + _SEEDS + _attach("(n.d, p.k)") + _NUMBERED
_COVERED = """, w as (select v.id, v.k, count(n.dst) as deg from v left join n on n.src = v.id group by 1, 2)"""
_SETCOVER = _GRAPH + _COVERED + _ranked("deg desc, k", "w") + _SEEDS + _attach("p.i") + _NUMBERED

_COMPLETE = (
    _GRAPH
    + _ranked("k")
    + """, size as (select count(*) as n from v),
 merge(t, cells, m) as (
   select 0::bigint, (select list(struct_pack(d := e.d, a := least(p.i, q.i) - 1, b := greatest(p.i, q.i) - 1)) from e join o as p on p.id = e.src join o as q on q.id = e.dst), null::struct(d double, a bigint, b bigint)
   union all
   select t + 1, (
     select list(struct_pack(d := mx, a := x, b := y)) from (
       select case when c.a in (low.a, low.b) then c.b when c.b in (low.a, low.b) then c.a else c.a end as x,
              case when c.a in (low.a, low.b) or c.b in (low.a, low.b) then (select n from size) + t else c.b end as y,
              max(c.d) as mx, count(*) as k
       from (select unnest(cells) as c) where not (c.a = low.a and c.b = low.b) group by 1, 2
     ) where y < (select n from size) + t or k = 2), low
   from (select t, cells, list_min(cells) as low from merge where len(cells) > 0)
 ),
 logged as (select (select n from size) + t - 1 as node, m.a as a, m.b as b from merge where m is not null),
 up as (select a as x, node from logged union all select b, node from logged),
 climb(leaf, node) as (select i - 1, i - 1 from o union all select climb.leaf, up.node from climb join up on up.x = climb.node),
 top as (select leaf, max(node) as root from climb group by 1),
 keyed as (select o.id, -top.root as key from top join o on o.i - 1 = top.leaf)"""
    + _NUMBERED
)

_LISTED = """, objects as (select id as object, row_number() over (order by min(rec_id)) - 1 as gi from toy_ids where id is not null group by id)"""
_PROC = """, o as (select v.id, v.k, row_number() over (order by objects.gi is null, objects.gi, v.k) as i from v left join objects on objects.object = v.id)"""
_FILLED = """, known as (select objects.object, objects.gi, numbers.cluster from objects left join keyed on keyed.id = objects.object left join numbers on numbers.key = keyed.key),
 whole as (select object, gi, cluster from known where cluster is not null union all
   select object, gi, (select count(*) from numbers) + row_number() over (order by gi) - 1 from known where cluster is null)"""
_WITH_OBJECTS = _GRAPH + _LISTED + _PROC + _REACH + """, keyed as (select x as id, min(o.i) as key from reach join o on o.id = reach.y group by 1)""" + _NUMBERED + _FILLED
_WITH_OBJECTS_CDHIT = _GRAPH + _LISTED + _PROC + _SEEDS + _attach("p.i") + _NUMBERED + _FILLED
_NUMERIC = (
    _GRAPH.replace("id1", "idx1").replace("id2", "idx2")
    + """, objects as (select gi, min(object) as object from (select idx1 as gi, id1 as object from toy_ani union all select idx2, id2 from toy_ani) where gi is not null and object is not null group by 1)"""
    + _PROC.replace("objects.object = v.id", "objects.gi = v.id")
    + _REACH
    + """, keyed as (select x as id, min(o.i) as key from reach join o on o.id = reach.y group by 1)"""
    + _NUMBERED
    + _FILLED.replace("keyed.id = objects.object", "keyed.id = objects.gi")
)
_VIR61 = """
with recursive r as (select id1 as a, id2 as b from vir61_ani where ani between {low} and {high} and not isnan(ani) and id1 <> id2),
 e as (select distinct least(a, b) as src, greatest(a, b) as dst from r),
 n as (select src, dst from e union all select dst, src from e),
 v as (select id, row_number() over (order by k) as k from (
   select id, min(struct_pack(x := x, y := y, pos := pos)) as k from (select a as id, {x} as x, {y} as y, 0 as pos from r union all select b, {x}, {y}, 1 from r) group by 1))
"""
_VIR_SINGLE = _VIR61.format(low=0.95, high=1.0, x="a", y="b") + _ranked("k") + _REACH + """, keyed as (select x as id, min(o.i) as key from reach join o on o.id = reach.y group by 1)""" + _NUMBERED
_VIR_PERCENT = _VIR61.format(low=95, high=100, x="least(a, b)", y="greatest(a, b)") + _COVERED + _ranked("deg desc, k", "w") + _SEEDS + _attach("p.i") + _NUMBERED
_WHOLE = _VIR61.replace("from vir61_ani", "from (select id1, id2, case when ani > 1 then ani * 0.01 else ani end as ani from vir61_ani)").format(low=0.95, high=1.0, x="least(a, b)", y="greatest(a, b)")
# a merge for every edge that joins two components of the shorter edges: components before less components after
_FOREST = """, cuts as (select unnest([{cuts}]::double[]) as cut),
 linked(cut, x, y) as (select cut, id, id from v, cuts union select linked.cut, linked.x, n.dst from linked join n on n.src = linked.y and n.d <= linked.cut),
 parts as (select cut, x, min(y) as root from linked group by 1, 2)
select cut, count(*) - count(distinct root) as n_merges from parts group by 1 having count(*) > count(distinct root)"""
_BOUNDS = "(select list(x) from (select unnest(" + str(edges.histogram_bounds()) + ") as x))"

ORACLE = {
    "pairs_transform_similarity": "select row_id, 1.0 - tani as d from toy_ani where tani is not null and not isnan(tani)",
    "pairs_transform_identity": "select row_id, cov as d from toy_ani where cov is not null and not isnan(cov)",
    "pairs_transform_percent": "select id1, id2, 1.0 - ani * 0.01 as d from vir61_ani where ani > 1 and not isnan(ani)",
    "pairs_filter_min": "select row_id from toy_ani where ani >= 0.9 and not isnan(ani)",
    "pairs_filter_max": "select row_id from toy_ani where cov <= 0.4 and not isnan(cov)",
    "pairs_filter_multi": "select row_id from toy_ani where ani >= 0.8 and not isnan(ani) and cov between 0.5 and 0.9 and not isnan(cov) and num_alns <= 40",
    "pairs_filter_tightest": "select row_id from toy_ani where ani between 0.85 and 0.95 and not isnan(ani)",
    "pairs_drop_self": "select row_id from toy_ani where id1 <> id2",
    "pairs_to_numbers": "with recursive x as (select 1)" + _LISTED + " select row_id, p.gi as id1, q.gi as id2 from toy_ani t join objects p on p.object = t.id1 join objects q on q.object = t.id2",
    "edges_symmetrize": _GRAPH + " select src, dst, d from n",
    "edges_canonical": _GRAPH + " select src, dst, d from e",
    "edges_unfiltered": "select least(id1, id2) as src, greatest(id1, id2) as dst, min(1.0 - tani) as d from toy_ani where id1 <> id2 and tani is not null and not isnan(tani) group by 1, 2",
    "edge_counts": _GRAPH + " select (select count(*) from r) as n_rows, (select count(*) from e) as n_edges, (select count(*) from n) as n_directed",
    "vertices_first_appearance": _GRAPH + " select id as object, k // 2 as first_row, k % 2 as first_col from v",
    "vertex_degree": _GRAPH + " select src as object, count(*) as degree from n group by 1",
    "distance_histogram": _GRAPH + f" select len(list_filter({_BOUNDS}, lambda b: b <= d)) as bin, count(*) as n from n group by 1",
    "cluster_single": _SINGLE + _OUT,
    "cluster_cdhit": _CDHIT + _OUT,
    "cluster_uclust": _UCLUST + _OUT,
    "cluster_setcover": _SETCOVER + _OUT,
    "cluster_complete": _COMPLETE + _OUT,
    "cluster_single_rounds": _SINGLE + _OUT,
    "cluster_cdhit_rounds": _CDHIT + _OUT,
    "cluster_uclust_rounds": _UCLUST + _OUT,
    "cluster_setcover_rounds": _SETCOVER + _OUT,
    "cluster_complete_rounds": _COMPLETE + _OUT,
    "cluster_representatives": _SINGLE + " select id as object, min(id) over (partition by cluster) as cluster from keyed join numbers using (key)",
    "cluster_with_objects": _WITH_OBJECTS + " select object, cluster from whole",
    "cluster_with_objects_cdhit": _WITH_OBJECTS_CDHIT + " select object, cluster from whole",
    "cluster_numeric_objects": _NUMERIC + " select object, cluster from whole",
    "cluster_sizes": _SINGLE + " select cluster, m as n_objects from numbers",
    "cluster_count": _WITH_OBJECTS + " select count(*) as n_clusters, count(*) filter (where m = 1) as n_singletons, sum(m)::bigint as n_objects from (select cluster, count(*) as m from whole group by 1)",
    "partition_agreement": _SINGLE
    + """, a as (select id as item, cluster as c1 from keyed join numbers using (key)), b as (select distinct object as item, cluster as c2 from toy_clusters where object is not null and cluster is not null),
 n1 as (select c1, count(*) as n1 from a group by 1), n2 as (select c2, count(*) as n2 from b group by 1),
 m as (select c1, c2, count(*) as n12 from a join b using (item) group by 1, 2),
 s as (select c1, c2, n12, n12 / (n1 + n2 - n12) as j from m join n1 using (c1) join n2 using (c2))
select sum(n12)::bigint as n_items, count(distinct c1) as n_clusters_left, count(distinct c1) filter (where j < 1) as n_mismatched, round(sum(j * n12) / sum(n12), 9) as similarity from s""",
    "vir61_single": _VIR_SINGLE + _OUT,
    "vir61_percent": _VIR_PERCENT + _OUT,
    "leiden_holds": _GRAPH + " select count(*) as n_objects, 0::bigint as n_gaining_moves, 0::bigint as n_gaining_merges, 0::bigint as n_split from v",
    "load_counts": _GRAPH + " select (select count(*) from toy_ani) as n_parsed, (select count(*) from r) as n_rows, (select count(*) from e) as n_edges, (select count(*) from n) as n_directed",
    "distance_histogram_whole": f"""with e as (select min(1.0 - tani) as d from toy_ani where id1 <> id2 and tani is not null and not isnan(tani) group by least(id1, id2), greatest(id1, id2))
select len(list_filter({_BOUNDS}, lambda b: b <= d)) as bin, 2 * count(*) as n from e group by 1""",
    "vir61_whole_single": _WHOLE + _ranked("k") + _REACH + """, keyed as (select x as id, min(o.i) as key from reach join o on o.id = reach.y group by 1)""" + _NUMBERED + _OUT,
    "vir61_whole_setcover": _WHOLE + _COVERED + _ranked("deg desc, k", "w") + _SEEDS + _attach("p.i") + _NUMBERED + _OUT,
    "vir61_whole_cdhit": _WHOLE + _ranked("k") + _SEEDS + _attach("p.i") + _NUMBERED + _OUT,
    # an edge is a merge if the edges before it don't lead from one of its ends to the other
    "merge_tree": _GRAPH
    + """, o as (select src, dst, d, row_number() over (order by d, src, dst) as i from e), m as (select src, dst, i from o union all select dst, src, i from o),
 walk(i, y) as (select i, src from o union select walk.i, m.dst from walk join m on m.src = walk.y and m.i < walk.i)
select row_number() over (order by i) - 1 as step, src, dst, d from o where not exists (select 1 from walk where walk.i = o.i and walk.y = o.dst)""",
    "merge_heights": _GRAPH + _FOREST.format(cuts=", ".join(map(str, CUTS))),
    "text_pairs": "select row_id, coalesce(id1, '') as id1, coalesce(id2, '') as id2, tani from toy_ani where tani is not null and not isnan(tani)",
    "text_pairs_numeric": "select row_id, idx1, idx2, tani from toy_ani where idx1 is not null and idx2 is not null and tani is not null and not isnan(tani)",
    "text_clusters": _SINGLE + _OUT,
    "text_objects": "with recursive x as (select 1)" + _LISTED + " select object, gi from objects",
    "output_order": _SINGLE + " select row_number() over (order by cluster, id) - 1 as place, id as object, cluster from keyed join numbers using (key)",
    "output_order_listed": _WITH_OBJECTS + " select row_number() over (order by cluster, gi) - 1 as place, object, arg_min(object, gi) over (partition by cluster) as cluster from whole",
    "edge_dump": _GRAPH + " select row_number() over (order by src, k) - 1 as place, format('{},{},{:.10f}', src, dst, d) as line from n join v on v.id = n.dst",
}
