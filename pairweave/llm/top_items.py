"""Top N items within every group, pruned by lower bounds of partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairweave.runtime import cut
from pairweave.sources.tables import table

#: Rows that one bound is taken from at most; larger pieces give sharper bounds and take more memory.
PIECE = 400_000
#: Only groups that hold one in so many rows get a bound; by the pigeonhole principle there are at most so many.
BOUNDED_GROUPS = 100_000


def piece_bounds(n: int, piece: int = PIECE) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per group of each piece of a partition, the N-th best distinct item (if there are N) and the rows seen.

    Better means a higher score, then a smaller item. Whatever other pieces hold, N items at least as good exist, so
    no worse row can be among the best N of its group.
    """

    def bounds(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        rows = t.group_by("g", use_threads=False).aggregate([("g", "count")])
        per = t.group_by(["g", "item"], use_threads=False).aggregate([("score", "max")]).sort_by([("g", "ascending"), ("score_max", "descending"), ("item", "ascending")])
        codes = pc.dictionary_encode(per["g"]).combine_chunks().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        sizes = np.diff(np.r_[starts, len(codes)])
        nth = per.take(pa.array(starts[sizes >= n] + n - 1))
        nth = pa.table({"g": nth["g"], "bound": nth["score_max"], "item": nth["item"]})
        out = rows.join(nth, "g", join_type="left outer", use_threads=False)
        return pa.table({"g": out["g"].cast(pa.string()), "n": out["g_count"].cast(pa.int64()), "bound": out["bound"].cast(pa.float64()), "item": out["item"].cast(pa.string())}).combine_chunks()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= piece:
                yield from bounds(held).to_batches()
                held, size = [], 0
        if held:
            yield from bounds(held).to_batches()

    return run


def top_items(rows: DataFrame, n: int, *, bounded_groups: int = BOUNDED_GROUPS, piece: int = PIECE) -> DataFrame:
    """``(g, place, item, score)``: the ``n`` best items of every group of ``rows(g, item, score)``, place 1 the best.

    An item counts once per group, with its highest score; equal scores are ordered by smaller item. Rows with a null
    group, item or score, or a score that is not a number, don't count. Groups with fewer items have fewer rows. An
    empty table gives an empty result.

    One pass over the rows takes every piece's N-th best item as a bound for its group; the best bound of each group
    that holds at least ``1/bounded_groups`` of the rows (so at most ``bounded_groups`` of them) is broadcast, and a
    second pass keeps only rows that reach it. Only survivors are shuffled: a few rows for a large group, however
    large, and all rows for a group that is small. Other groups have no bound and lose no row to one. A group with so
    few distinct items that no piece has N has no bound either, but its repeats are folded into one row per item and
    task before the shuffle, and each task passes on its best N items of a group only.
    """
    rows = rows.select(F.col("g").cast("string").alias("g"), F.col("item").cast("string").alias("item"), F.col("score").cast("double").alias("score"))
    rows = rows.filter("g is not null and item is not null and score is not null and not isnan(score)")
    pieces = rows.mapInArrow(piece_bounds(n, piece), "g string, n long, bound double, item string")
    best = F.min(F.when(F.col("bound").isNotNull(), F.struct((-F.col("bound")).alias("neg"), F.col("item").alias("item"))))
    groups = cut(pieces.groupBy("g").agg(F.sum("n").alias("n"), best.alias("b")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bounds = groups.filter(F.col("b").isNotNull() & (F.col("n") * bounded_groups >= total)).select("g", "b")
    reached = F.col("b").isNull() | (F.struct((-F.col("score")).alias("neg"), F.col("item").alias("item")) <= F.col("b"))
    kept = rows.join(F.broadcast(bounds), "g", "left").filter(reached).select("g", "item", "score")
    # the first shuffle is by group and item, so that no group meets in one task; the second moves N rows a task
    distinct = kept.groupBy("g", "item").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), F.asc("item")))
    return distinct.withColumn("place", place.cast("long")).filter(F.col("place") <= n).select("g", "place", "item", "score")


def _partners(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "toy_ani", "id1", "id2", "ani")
    return rows.filter(F.col("ani").between(0.0, 1.0) & (F.col("id1") != F.col("id2"))).select(F.col("id1").alias("g"), F.col("id2").alias("item"), F.col("ani").alias("score"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three partners of highest ani of every object in id1."""
    return top_items(_partners(spark, folder), 3).select(F.col("g").alias("object"), "place", F.col("item").alias("partner"))


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    """As p6_found, the ten best with their ani."""
    return top_items(_partners(spark, folder), 10).select(F.col("g").alias("object"), "place", F.col("item").alias("partner"), F.col("score").alias("ani"))


QUERIES = {"p6_found": p6_found, "p6_scores": p6_scores}

_RANKED = """
with best as (select id1, id2, max(ani) as ani from toy_ani where ani between 0 and 1 and not isnan(ani) and id1 <> id2 group by 1, 2),
     r as (select id1 as object, row_number() over (partition by id1 order by ani desc, id2) as place, id2 as partner, ani from best)
"""
ORACLE = {
    "p6_found": _RANKED + "select object, place, partner from r where place <= 3",
    "p6_scores": _RANKED + "select object, place, partner, ani from r where place <= 10",
}
