"""The shared skeleton of the iterative operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.runtime import cut

#: Up to so many directed entries, an iterative operator finishes in one task; the count is taken first.
SMALL_GRAPH = 400_000


#: Rows that a task of :func:`per_component` should have; a larger component has a task of that size.
TASK_ROWS = 100_000


def per_component(rows: DataFrame, solve: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """Run ``solve`` on the rows of every component (column ``comp``) and gather the tuples it returns.

    Many small components share a task, because a grouped task of its own for each would mostly be overhead.
    """
    names = [field.strip().split(" ")[0] for field in schema.split(",")]
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("comp", kind="stable", ignore_index=True)
        comp = pdf["comp"].to_numpy()
        cuts = [0, *[i for i in range(1, len(comp)) if comp[i] != comp[i - 1]], len(comp)]
        out: list[tuple] = []
        for a, b in zip(cuts, cuts[1:]):
            out += solve(pdf.iloc[a:b])
        return pd.DataFrame(out, columns=names)

    bucket = F.pmod(F.xxhash64("comp"), F.lit(tasks)).alias("_task")
    return rows.groupBy(bucket).applyInPandas(lambda pdf: run(pdf), schema)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def follow_to_roots(parents: DataFrame) -> DataFrame:
    """``(id, root)`` for a forest ``(id, parent)``; an object that is nobody's id, or its own parent, is a root.

    Pointer doubling: paths of length n take about log2(n) rounds. Ids must be unique.
    """
    state = cut(parents.select("id", F.col("parent").alias("root")))
    while True:
        above = state.select(F.col("id").alias("_above"), F.col("root").alias("_next"))
        state = cut(
            state.join(above, F.col("root") == F.col("_above"), "left")
            .select("id", F.coalesce("_next", "root").alias("root"), (F.col("_next") != F.col("root")).alias("_moved"))
        )
        if is_empty(state.filter("_moved")):
            return state.select("id", "root")
        state = state.select("id", "root")
