"""From a pair table to a canonical undirected graph."""

from __future__ import annotations

import sys
from itertools import accumulate, repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.functions.transforms import range_predicate, to_distance, usable


def surviving_pairs(pairs: DataFrame, id_cols: tuple[str, str], distance_col: str, *, kind: str = "distance", minimum=None, maximum=None, order: Column | None = None, numeric_ids: bool = False) -> DataFrame:
    """Rows ``(a, b, d, ord)`` that pass the filters and relate two different objects.

    Filters act on raw values with inclusive bounds; null and not-a-number fail them. Rows with a null id are
    dropped. ``order`` gives the order in which rows count as read (default: the two ids), and may be any sortable
    column. Only the two ids, the distance, the filter columns and the order are read from the input; other columns,
    whatever their names, are ignored. An empty table gives an empty result.
    """
    predicate = range_predicate(minimum, maximum)
    if predicate is not None:
        pairs = pairs.filter(predicate)
    kind_of_id = "bigint" if numeric_ids else "string"
    a, b = (F.col(f"`{c}`").cast(kind_of_id) for c in id_cols)
    rows = pairs.select(a.alias("a"), b.alias("b"), to_distance(F.col(f"`{distance_col}`"), kind).alias("d"), (F.struct(a, b) if order is None else order).alias("ord"))
    return rows.filter((F.col("a") != F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull())


def symmetrize(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions of every edge, by one pass over the input rather than a union of two."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    both = F.explode(F.array(F.struct(F.col(src).alias("src"), F.col(dst).alias("dst")), F.struct(F.col(dst).alias("src"), F.col(src).alias("dst"))))
    return edges.select(both.alias("_e"), *rest).select("_e.src", "_e.dst", *rest)


def canonical_edges(rows: DataFrame, with_distance: bool = True) -> DataFrame:
    """One row ``(src, dst, d)`` per unordered pair, ``src < dst``, with the smallest usable distance of its rows.

    The minimum is aggregated before the shuffle, so a pair repeated without bound costs one row per task. Without
    ``with_distance`` only ``(src, dst)`` come out and the distance column is pruned.
    """
    rows = rows.filter(usable(F.col("d")) & (F.col("d") < F.lit(sys.float_info.max)))
    pair = (F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    if not with_distance:
        return rows.select(*pair).distinct()
    return rows.select(*pair, "d").groupBy("src", "dst").agg(F.min("d").alias("d"))


def vertices(rows: DataFrame) -> DataFrame:
    """``(id, appear_key)`` for every object of a surviving row; ``appear_key`` sorts by first appearance, the first
    id column before the second within a row."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(0).alias("pos")), F.struct(F.col("b").alias("id"), F.lit(1).alias("pos"))))
    return (
        rows.select(ends.alias("_v"), "ord")
        .select(F.col("_v.id").alias("id"), F.struct(F.col("ord"), F.col("_v.pos").alias("pos")).alias("key"))
        .groupBy("id")
        .agg(F.min("key").alias("appear_key"))
    )


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, degree)``: neighbours after removal of repeats."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def edge_counts(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: rows that survived, undirected edges, directed entries."""
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), (2 * F.count(F.lit(1))).alias("n_directed"))
    return n.unionByName(e, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("n_rows", "n_edges", "n_directed")])


def load_counts(pairs: DataFrame, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: rows of the table whether they survive or not, and what :func:`edge_counts` says."""
    parsed = pairs.agg(F.count(F.lit(1)).alias("n_parsed"))
    counts = edge_counts(rows, edges)
    return parsed.unionByName(counts, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("n_parsed", "n_rows", "n_edges", "n_directed")])


def histogram_bounds(step: float = 0.001, top: float = 0.05) -> list[float]:
    """Upper bounds 0, step, 2 step, ... added one by one until ``top`` is reached; the last bin is unbounded."""
    steps = accumulate(repeat(step), initial=0.0)
    bounds = []
    for bound in steps:
        bounds.append(bound)
        if bound >= top:
            return bounds
    return bounds


def distance_histogram(edges: DataFrame, step: float = 0.001, top: float = 0.05) -> DataFrame:
    """``(bin, upper, n)``: directed entries whose distance is below ``upper`` and not below the bound before it.

    The last bin has a null ``upper``. Empty bins are left out.
    """
    bounds = histogram_bounds(step, top)
    array = F.array(*[F.lit(b) for b in bounds])
    binned = edges.select(F.size(F.filter(array, lambda b: b <= F.col("d"))).alias("bin"))
    counted = binned.groupBy("bin").agg((2 * F.count(F.lit(1))).alias("n"))
    return counted.select(F.col("bin").cast("long").alias("bin"), F.get(array, F.col("bin")).alias("upper"), "n")
