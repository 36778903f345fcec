"""Cluster numbers, representatives, listed objects and output order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairweave.operators.skew import heavy_split_join
from pairweave.runtime import cut, materialised

#: Up to so many counted rows, one task numbers a table.
SMALL_TABLE = 200_000


def numbered_clusters(keyed: DataFrame) -> DataFrame:
    """``(cluster_key, n, cluster)``: 0-based numbers by size, largest first, ties by key.

    See :func:`with_position` for how a large number of clusters is numbered without a window over all of them.
    """
    sizes = keyed.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n"))
    return with_position(sizes, [F.desc("n"), F.asc("cluster_key")], "cluster")


def with_position(df: DataFrame, order: list[Column], name: str, small_table: int = SMALL_TABLE, *, weight: str | None = None) -> DataFrame:
    """Append the 0-based position of each row in ``order``, which must be total; with ``weight``, a column of whole
    numbers, the sum of the weights of the rows before.

    Up to :data:`SMALL_TABLE` counted rows are numbered by one task. Beyond, rows are range-partitioned by the order,
    and each partition adds what comes before it.
    """
    df = materialised(df)
    unit = F.lit(1) if weight is None else F.col(weight)

    def place(window) -> Column:
        if weight is None:
            return F.row_number().over(window) - 1
        return F.sum(unit).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - unit

    if df.count() <= small_table:
        return df.withColumn(name, place(Window.orderBy(*order)).cast("long"))
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.sum(unit).alias("n")).collect())  # one row a partition
    offsets, total = [], 0
    for part, count in counts:
        offsets.append((part, total))
        total += count
    before = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    placed = ranged.withColumn("_place", place(Window.partitionBy("_part").orderBy(*order)))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def number_assignments(keyed: DataFrame) -> DataFrame:
    """``(id, cluster)`` from ``(id, cluster_key)``."""
    keyed = materialised(keyed)
    numbers = numbered_clusters(keyed)
    return heavy_split_join(keyed, numbers, "cluster_key", "n", keyed.count()).select("id", "cluster")


def add_listed_objects(assigned: DataFrame, objects: DataFrame, *, missing: str = "raise") -> DataFrame:
    """``(object, cluster, gi)`` for every row of ``objects(object, gi)``.

    Listed objects that the graph lacks become clusters of one, numbered after all others in list order. An object
    of the graph that isn't listed is an error, or is left out with ``missing="drop"``. Listed names must be unique.
    """
    if missing not in ("raise", "drop"):
        raise ValueError("missing must be 'raise' or 'drop'")
    assigned, objects = materialised(assigned), materialised(objects, "object", "gi")
    repeated = objects.groupBy("object").count().filter("count > 1").take(1)
    if repeated:
        raise ValueError(f"object {repeated[0]['object']!r} is listed more than once")
    if missing == "raise":
        unknown = assigned.join(objects.select(F.col("object").alias("id")), "id", "left_anti").take(1)
        if unknown:
            raise ValueError(f"object {unknown[0]['id']!r} has pairs but isn't listed")
    n_clusters = assigned.agg(F.max("cluster")).first()[0]
    n_clusters = 0 if n_clusters is None else n_clusters + 1
    joined = cut(objects.join(assigned.withColumnRenamed("id", "object"), "object", "left"))
    alone = with_position(joined.filter("cluster is null").drop("cluster"), [F.asc("gi")], "_k")
    alone = alone.select("object", (F.lit(n_clusters) + F.col("_k")).cast("long").alias("cluster"), "gi")
    return joined.filter("cluster is not null").select("object", F.col("cluster").cast("long").alias("cluster"), "gi").unionByName(alone)


def representatives(assigned: DataFrame, out_key: str) -> DataFrame:
    """Replace ``cluster`` by the object that comes first in the cluster in output order; ``cluster_no`` keeps the
    number."""
    assigned = materialised(assigned)
    first = assigned.groupBy("cluster").agg(F.min_by("object", out_key).alias("_rep"), F.count(F.lit(1)).alias("_n"))
    named = heavy_split_join(assigned, first, "cluster", "_n", assigned.count())
    return named.withColumns({"cluster_no": F.col("cluster"), "cluster": F.col("_rep")}).drop("_rep")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """``(cluster, n_objects)``."""
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_objects"))


def cluster_count(assigned: DataFrame) -> DataFrame:
    """One row: clusters, those of a single object, objects."""
    sizes = cluster_sizes(assigned)
    return sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("n_objects") == 1).alias("n_singletons"), F.coalesce(F.sum("n_objects"), F.lit(0)).alias("n_objects"))
