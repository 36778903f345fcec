"""Grouping and joining where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.runtime import cut, derived, materialised

#: A key counts as heavy from one in so many rows on; by the pigeonhole principle there are at most so many.
HEAVY_SHARE = 2_000
#: A side of up to so many counted rows is broadcast whole.
SMALL_SIDE = 50_000


def heavy_split_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, *, how: str = "inner", share: int = HEAVY_SHARE, small_side: int = SMALL_SIDE, rows: int | None = None) -> DataFrame:
    """Join ``left`` with ``right``, whose keys are unique, without sending a heavy key's rows to one task.

    ``right[weight]`` counts the rows of ``left`` per key and ``total`` all of them. At most ``share`` keys can hold
    a ``1/share`` of the rows each; their rows of ``right`` are broadcast, all others meet in a shuffled join.
    A ``right`` of up to ``small_side`` rows, which are counted unless ``rows`` says how many there are, is broadcast
    whole. ``how`` is ``inner`` or ``left``. Null keys match nothing.
    """
    limit = max(1, -(-total // share))
    payload = [c for c in right.columns if c != weight]
    right = materialised(right)
    if (right.count() if rows is None else rows) <= small_side:
        return left.join(F.broadcast(right.select(*payload)), key, how)
    heavy = F.broadcast(right.filter(F.col(weight) >= limit).select(*payload))
    light = right.filter(F.col(weight) < limit).select(*payload)
    one = left.join(heavy, key, "inner")
    rest = left.join(heavy.select(key), key, "left_anti").join(light, key, how)
    return one.unionByName(rest)


def label_ends(arcs: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """``arcs(src, dst, ...)`` with the label of either end as ``a`` and ``b``.

    ``labels(id, c, degree)`` has every end once, with the number of arcs that leave it; ``total`` counts the arcs,
    which stand in both directions. See :func:`heavy_split_join` for hubs.
    """
    labels = materialised(labels)
    there = derived(labels, F.col("id").alias("src"), F.col("c").alias("a"), "degree")
    back = derived(labels, F.col("id").alias("dst"), F.col("c").alias("b"), "degree")
    rows = labels.count()
    return heavy_split_join(heavy_split_join(arcs, there, "src", "degree", total, rows=rows), back, "dst", "degree", total, rows=rows)


_STATE = "k string, pid int, n_rows long, n_partners long, first_partner string, last_partner string, best double, best_partner string"


def _partial_states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per key of a sorted partition, streamed: a key's state is emitted when the next key begins."""
    names = ["k", "pid", "n_rows", "n_partners", "first_partner", "last_partner", "best", "best_partner"]
    schema = pa.schema([("k", pa.string()), ("pid", pa.int32()), ("n_rows", pa.int64()), ("n_partners", pa.int64()), ("first_partner", pa.string()), ("last_partner", pa.string()), ("best", pa.float64()), ("best_partner", pa.string())])
    held: dict | None = None

    def fold(a: dict | None, b: dict) -> tuple[dict | None, dict]:
        """(finished state or None, open state)"""
        if a is None:
            return None, b
        if a["k"] != b["k"]:
            return a, b
        same = a["last_partner"] is not None and a["last_partner"] == b["first_partner"]
        better = b["best"] is not None and (a["best"] is None or b["best"] > a["best"] or (b["best"] == a["best"] and b["best_partner"] < a["best_partner"]))
        return None, {
            "k": a["k"],
            "pid": a["pid"],
            "n_rows": a["n_rows"] + b["n_rows"],
            "n_partners": a["n_partners"] + b["n_partners"] - same,
            "first_partner": a["first_partner"] if a["first_partner"] is not None else b["first_partner"],
            "last_partner": b["last_partner"] if b["last_partner"] is not None else a["last_partner"],
            "best": b["best"] if better else a["best"],
            "best_partner": b["best_partner"] if better else a["best_partner"],
        }

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.table(batch)
        # runs of equal (key, partner), in order
        per = t.group_by(["k", "p"], use_threads=False).aggregate([("pid", "min"), ("v", "max"), ("v", "count"), ("one", "sum")])
        ranked = per.sort_by([("k", "ascending"), ("v_max", "descending"), ("p", "ascending")])
        tops = ranked.filter(pc.is_valid(ranked["v_max"])).group_by("k", use_threads=False).aggregate([("v_max", "first"), ("p", "first")])
        best = {k: (v, p) for k, v, p in zip(tops["k"].to_pylist(), tops["v_max_first"].to_pylist(), tops["p_first"].to_pylist())}
        keyed = per.group_by("k", use_threads=False).aggregate([("one_sum", "sum"), ("p", "count"), ("p", "min"), ("p", "max"), ("pid_min", "min")])
        done = []
        for row in keyed.sort_by([("k", "ascending")]).to_pylist():
            v, p = best.get(row["k"], (None, None))
            finished, held = fold(held, {"k": row["k"], "pid": row["pid_min_min"], "n_rows": row["one_sum_sum"], "n_partners": row["p_count"], "first_partner": row["p_min"], "last_partner": row["p_max"], "best": v, "best_partner": p})
            if finished:
                done.append(finished)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema).select(names)
    if held:
        yield pa.RecordBatch.from_pylist([held], schema=schema).select(names)


def key_profile(df: DataFrame, key: str, partner: str, value: str, order: str, *, low: float = 0.0, high: float = 1.0, partitions: int | None = None) -> DataFrame:
    """Per-key rows, distinct partners and best value, balanced however the rows spread over keys.

    Rows are range-partitioned on ``(key, partner, order)`` with sampled quantiles, so a heavy key, and even a heavy
    pair, spreads over as many partitions as its share of the rows asks for. Each sorted partition streams into one
    partial state per key; states of a key that crosses boundaries are stitched, and a partner that ends one
    partition and begins the next counts once. Only states are shuffled again.

    Result: ``(object, n_rows, n_partners, best, best_partner)``. ``best`` is the largest value from ``low`` to
    ``high`` (null and not-a-number aside) of a row with a partner other than the key itself, ``best_partner`` the
    smallest partner that has it; both are null if no row qualifies. A null partner counts as a row, not as a
    partner. Rows with a null key form one group with a null ``object``. Repeated rows count as rows. An empty table
    gives an empty result.
    """
    v = F.col(f"`{value}`").cast("double")
    fits = v.between(low, high) & ~F.isnan(v) & (F.col(f"`{key}`") != F.col(f"`{partner}`"))
    # a prefix keeps null keys apart from every name, and sorts them first
    k = F.when(F.col(f"`{key}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("k"), F.col(f"`{key}`")))
    rows = df.select(k.alias("k"), F.col(f"`{partner}`").cast("string").alias("p"), F.when(fits, v).alias("v"), F.col(f"`{order}`").alias("o"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "k", "p", "o").sortWithinPartitions("k", "p")
    states = ranged.select("k", "p", "v", F.spark_partition_id().alias("pid"), F.lit(1).cast("long").alias("one")).mapInArrow(_partial_states, _STATE)
    return _stitched(states)


def _stitched(states: DataFrame) -> DataFrame:
    """Merge the states of each key; a key has one per partition at most, so the lists stay short."""
    parts = F.sort_array(F.collect_list(F.struct("pid", "first_partner", "last_partner")))
    merged = states.groupBy("k").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_partners").alias("n_partners"),
        F.max("best").alias("best"),
        F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best")).alias("neg"), F.col("best_partner").alias("bp")))).alias("first"),
        F.filter(parts, lambda x: x["last_partner"].isNotNull()).alias("parts"),
    )
    seams = F.expr("size(filter(transform(sequence(1, greatest(size(parts), 1)), i -> i < size(parts) and get(parts, i - 1).last_partner = get(parts, i).first_partner), x -> x))")
    return merged.select(
        F.when(F.col("k") != "", F.expr("substring(k, 2)")).alias("object"),
        "n_rows",
        (F.col("n_partners") - seams).cast("long").alias("n_partners"),
        "best",
        F.col("first.bp").alias("best_partner"),
    )


def heavy_keys(profile: DataFrame, share: float) -> DataFrame:
    """``(object)``: keys that hold at least ``share`` of all rows, those without a key counted in the total."""
    profile = cut(profile.select("object", "n_rows"))
    total = profile.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"]
    return profile.filter(F.col("object").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.lit(total))).select("object")
