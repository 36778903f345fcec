"""Agreement of two partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_similarity(left: DataFrame, right: DataFrame, item: str = "object", cluster: str = "cluster") -> DataFrame:
    """One row ``(n_items, n_clusters_left, n_mismatched, similarity)`` over the items that both tables hold.

    ``similarity`` is the mean over items of the Jaccard index of the item's two clusters; ``n_mismatched`` counts
    clusters of the left table that differ from some cluster they meet. Items of one table only still count toward
    the size of their cluster. Two empty tables give a null similarity and zero counts. Repeated identical rows
    count once.
    """
    a = left.select(F.col(item).alias("item"), F.col(cluster).alias("c1")).distinct()
    b = right.select(F.col(item).alias("item"), F.col(cluster).alias("c2")).distinct()
    n1, n2 = a.groupBy("c1").agg(F.count(F.lit(1)).alias("n1")), b.groupBy("c2").agg(F.count(F.lit(1)).alias("n2"))
    both = a.join(b, "item").groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n12")).join(n1, "c1").join(n2, "c2")
    score = F.col("n12") / (F.col("n1") + F.col("n2") - F.col("n12"))
    per = both.select("c1", "n12", (score * F.col("n12")).alias("part"), (score < 1).alias("off"))
    per = per.groupBy("c1").agg(F.sum("n12").alias("n12"), F.sum("part").alias("part"), F.max("off").alias("off"))
    return per.agg(
        F.coalesce(F.sum("n12"), F.lit(0)).alias("n_items"),
        F.count(F.lit(1)).alias("n_clusters_left"),
        F.count_if("off").alias("n_mismatched"),
        F.round(F.sum("part") / F.sum("n12"), 9).alias("similarity"),
    )


def pairs_to_numeric(pairs: DataFrame, objects: DataFrame, id_cols: tuple[str, str]) -> DataFrame:
    """Replace both id columns by list positions (``gi`` of ``objects(object, gi)``); unlisted pairs drop out."""
    a, b = id_cols
    one = objects.select(F.col("object").alias("_o1"), F.col("gi").alias("_g1"))
    two = objects.select(F.col("object").alias("_o2"), F.col("gi").alias("_g2"))
    joined = pairs.join(one, F.col(f"`{a}`") == F.col("_o1")).join(two, F.col(f"`{b}`") == F.col("_o2"))
    return joined.withColumns({a: F.col("_g1"), b: F.col("_g2")}).drop("_o1", "_o2", "_g1", "_g2")
