"""From a pair table to an assignment table in one call."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.functions.transforms import KINDS
from pairweave.operators import assign, components, edges, greedy, leiden, linkage
from pairweave.operators.rounds import SMALL_GRAPH
from pairweave.runtime import cut

#: Methods by name; those flagged need distances, the others run on a plan from which the distance is pruned.
METHODS = {
    "single": (components.single_linkage, False),
    "complete": (linkage.complete_linkage, True),
    "uclust": (greedy.closest_seed, True),
    "set-cover": (greedy.set_cover, False),
    "cd-hit": (greedy.greedy_incremental, False),
    "leiden": (leiden.leiden, True),
}


@dataclass
class ClusterOptions:
    """What a run of :func:`cluster` can be told; defaults take the first three columns as ids and distance.

    ``small_graph`` and ``component_edges`` (of complete linkage and Leiden) say how much one task may hold.
    """

    algo: str = "single"
    id_cols: tuple[str, str] | None = None
    distance_col: str | None = None
    kind: str = "distance"
    minimum: dict | list | None = None
    maximum: dict | list | None = None
    numeric_ids: bool = False
    representatives: bool = False
    missing: str = "raise"
    leiden: dict = field(default_factory=dict)
    small_graph: int = SMALL_GRAPH
    component_edges: int | None = None

    def resolve(self, columns: list[str]) -> ClusterOptions:
        """Check against the table's columns and fill in what was left open. Id columns come in table order."""
        if self.algo not in METHODS:
            raise ValueError(f"unknown algorithm {self.algo!r}; choose from {', '.join(METHODS)}")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if len(columns) < 3:
            raise ValueError("a pair table has at least three columns")
        ids = tuple(self.id_cols) if self.id_cols else (columns[0], columns[1])
        distance = self.distance_col or columns[2]
        for name in (*ids, distance, *dict(self.minimum or {}), *dict(self.maximum or {})):
            if name not in columns:
                raise ValueError(f"the pair table has no column {name!r}")
        if len(set(ids)) != 2:
            raise ValueError("the two id columns must differ")
        if distance in ids:
            raise ValueError("the distance column can't be an id column")
        if set(ids) & {*dict(self.minimum or {}), *dict(self.maximum or {})}:
            raise ValueError("filters act on value columns, not on ids")
        ids = tuple(sorted(ids, key=columns.index))
        return replace(self, id_cols=ids, distance_col=distance)


@dataclass
class Graph:
    """The canonical graph of one run."""

    rows: DataFrame
    edges: DataFrame
    vertices: DataFrame


def build_graph(pairs: DataFrame, options: ClusterOptions, *, order: Column | None = None, objects: DataFrame | None = None) -> Graph:
    """Filter, transform, canonicalise; vertices get ``appear_key`` and ``proc_key``."""
    rows = edges.surviving_pairs(pairs, options.id_cols, options.distance_col, kind=options.kind, minimum=options.minimum, maximum=options.maximum, order=order, numeric_ids=options.numeric_ids)
    known = edges.vertices(rows)
    if objects is None:
        known = known.withColumn("proc_key", F.col("appear_key"))
    else:
        key = F.col("gi") if options.numeric_ids else F.col("object")
        listed = objects.select(key.alias("id"), F.col("gi").alias("proc_key"))
        known = known.join(listed, "id", "left")
        # objects that aren't listed are refused or dropped later; until then they come last, in order of appearance
        known = known.select("id", "appear_key", F.struct(F.col("proc_key").isNull().alias("late"), F.col("proc_key").alias("gi"), F.when(F.col("proc_key").isNull(), F.col("appear_key")).alias("seen")).alias("proc_key"))
    return Graph(rows, edges.canonical_edges(rows, METHODS[options.algo][1]), known)


def keyed_clusters(graph: Graph, options: ClusterOptions) -> DataFrame:
    """``(id, cluster_key)`` by the chosen method."""
    method, _ = METHODS[options.algo]
    extra = dict(options.leiden) if options.algo == "leiden" else {}
    if options.component_edges is not None and options.algo in ("complete", "leiden"):
        extra["component_edges"] = options.component_edges
    return method(cut(graph.edges), cut(graph.vertices), small_graph=options.small_graph, **extra)


def cluster(pairs: DataFrame, *, objects: DataFrame | None = None, order: Column | None = None, options: ClusterOptions | None = None, **named) -> DataFrame:
    """``(object, cluster, out_key, cluster_no)``, to be ordered by ``cluster_no, out_key`` for output.

    ``cluster`` is a 0-based number by size, largest first (for ``representatives`` the first object of the cluster
    in output order). Without ``objects(object, gi)`` only objects with a surviving pair come out, ordered by name
    within a cluster; with it exactly the listed ones, ordered by list position, those without a surviving pair as
    clusters of one. With ``numeric_ids`` the ids of the pair table are list positions if a list is given. ``order``
    says in which order rows count as read. No surviving pair gives an empty table, or all listed objects alone.
    """
    options = (options or ClusterOptions(**named)).resolve(pairs.columns)
    graph = build_graph(pairs, options, order=order, objects=objects)
    assigned = assign.number_assignments(keyed_clusters(graph, options))
    if objects is None:
        out = assigned.select(F.col("id").alias("object"), F.col("cluster").cast("long").alias("cluster"), F.col("id").alias("out_key"))
    elif options.numeric_ids:
        listed = assign.add_listed_objects(assigned, objects.select(F.col("gi").alias("object"), "gi"), missing=options.missing)
        out = listed.drop("object").join(objects.select("object", "gi"), "gi").select("object", "cluster", F.col("gi").alias("out_key"))
    else:
        out = assign.add_listed_objects(assigned, objects, missing=options.missing).select("object", "cluster", F.col("gi").alias("out_key"))
    return assign.representatives(out, "out_key") if options.representatives else out.withColumn("cluster_no", F.col("cluster"))
