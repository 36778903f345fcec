"""Mixing sources to target weights: weighted sampling within token budgets."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairweave.operators.skew import heavy_split_join
from pairweave.runtime import cut
from pairweave.sources.tables import table

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"

_ENCODERS: dict = {}


def _encoder(path: str):
    """A byte-level BPE of the ``tiktoken`` rank format, loaded once per worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        #: Fixed value: the splitting pattern published with this vocabulary.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _ENCODERS[path] = tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, *, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``documents(id, source, text)`` with ``n_tokens``; whole texts count, a null text has none."""
    path = f"{tokenizers}/{vocabulary}"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            batch["n_tokens"] = [len(encode(t)) if isinstance(t, str) else 0 for t in batch.pop("text")]
            yield batch

    rows = documents.select("id", "source", "quality", "text")
    return rows.mapInPandas(count, "id long, source string, quality double, n_tokens long")


def quality(text: Column) -> Column:
    """A weight from 0.1 to 1: the share of letters in the text, times how far its length is from a stub."""
    length = F.length(text)
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", "")) / F.greatest(length, F.lit(1))
    return F.greatest(F.lit(0.1), letters * F.least(F.lit(1.0), length / F.lit(200.0)))


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``(source, target_share, max_repeats, available, budget)`` for every listed source.

    ``sizes`` has ``source, available`` tokens. Shares are taken among the listed sources that have tokens and a
    positive share. Without ``total_tokens`` the total is the largest for which every such source can supply its
    share within its repeats; with it, a source that can't supplies what it can. Sources without tokens get none.
    """
    listed = targets.select("source", "target_share", "max_repeats").filter("source is not null")
    joined = listed.join(sizes.select("source", "available"), "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    live = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    limit = F.col("available") * F.col("max_repeats")
    facts = joined.agg(F.sum(F.when(live, F.col("target_share"))).alias("shares"), F.min(F.when(live, limit / F.col("target_share"))).alias("room")).first()
    shares = facts["shares"] or 1.0
    total = total_tokens if total_tokens is not None else int((facts["room"] or 0.0) * shares)
    want = F.floor(F.lit(total) * F.col("target_share") / F.lit(shares) + F.lit(1e-9))
    return joined.withColumn("budget", F.when(live, F.least(want, limit)).otherwise(F.lit(0)).cast("long"))


def mixture(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 1, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The mixed documents and the shares reached.

    ``documents(id, source, text, quality)`` have unique ids, ``targets(source, target_share, max_repeats)`` unique
    sources. Each source first contributes as many complete epochs as its budget holds, and then a part of itself:
    every document draws an exponential key, -ln(u) / quality with u from a hash of seed and id (Efraimidis and
    Spirakis), and documents are taken by ascending key while the running sum of tokens stays within what is left of
    the budget. So a source misses its budget by less than its longest document, and no document is repeated more
    often than the source's cap.

    The running sums of a source don't run in one task: documents are range-partitioned by source and key, the sums
    of partitions are accumulated, and each partition adds what comes before it.

    Result: ``(id, source, n_tokens, repeats)`` of the documents taken, and per listed source ``(source,
    target_share, max_repeats, available, budget, reached, reached_share, epochs, most_repeats)``. Documents without
    tokens, source or listing don't take part. Ties of keys are broken by id. Empty tables give empty results.
    """
    sized = cut(token_counts(documents.filter("source is not null"), tokenizers=tokenizers).filter("n_tokens > 0"))
    plan = cut(budgets(sized.groupBy("source").agg(F.sum("n_tokens").alias("available")), targets, total_tokens))
    allowed = plan.filter("budget > 0").select(
        "source", F.floor(F.col("budget") / F.col("available")).cast("int").alias("epochs"), (F.col("budget") % F.col("available")).alias("rest"), "available"
    )
    total = plan.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("n")).first()["n"]
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = heavy_split_join(sized, allowed, "source", "available", total).withColumn("draw", -F.log(u) / F.greatest(F.coalesce("quality", F.lit(0.1)), F.lit(1e-6)))
    n = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(keyed.repartitionByRange(n, "source", "draw", "id").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("source", "part").agg(F.sum("n_tokens").alias("tokens"))
    before = sums.select("source", "part", (F.sum("tokens").over(Window.partitionBy("source").orderBy("part")) - F.col("tokens")).alias("before"))
    # at most one row per partition and source that meets it
    within = F.sum("n_tokens").over(Window.partitionBy("source", "part").orderBy("draw", "id"))
    running = ranged.withColumn("within", within).join(before, ["source", "part"])
    taken = running.select("id", "source", "n_tokens", (F.col("epochs") + (F.col("before") + F.col("within") <= F.col("rest")).cast("int")).alias("repeats"))
    taken = cut(taken.filter("repeats > 0"))
    got = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("reached"), F.max("repeats").alias("most_repeats"))
    whole = taken.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n")).first()["n"] or 1
    report = plan.join(got, "source", "left").join(allowed.select("source", "epochs"), "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        "available",
        "budget",
        F.coalesce("reached", F.lit(0)).alias("reached"),
        F.round(F.coalesce("reached", F.lit(0)) / F.lit(whole), 6).alias("reached_share"),
        F.coalesce("epochs", F.lit(0)).alias("epochs"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    return taken, report


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents", "doc_id", "source", "text").select(F.col("doc_id").alias("id"), "source", "text", quality(F.col("text")).alias("quality"))
    return mixture(documents, table(spark, folder, "mix_targets", "source", "target_share", "max_repeats"))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture and how often each is repeated."""
    return _mixed(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per listed source: target share, tokens available, budget, tokens and share reached, repeats."""
    return _mixed(spark, folder)[1]


def p9_holds(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every listed source, from the documents taken: none is repeated more than allowed or in
    several rows, the tokens taken are within the budget, and the budget is missed by less than a document."""
    taken, report = _mixed(spark, folder)
    per = taken.groupBy("source").agg(
        F.max("repeats").alias("most"), F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("n_tokens").alias("longest")
    )
    whole = token_counts(table(spark, folder, "documents", "doc_id", "source", "text").select(F.col("doc_id").alias("id"), "source", "text", F.lit(1.0).alias("quality"))).groupBy("source").agg(F.max("n_tokens").alias("longest_of_all"))
    out = report.select("source", "target_share", "max_repeats", "budget").join(per, "source", "left").join(whole, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return out.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce((F.col("most") <= F.col("max_repeats")) & (F.col("n") == F.col("n_ids")), F.lit(True)).alias("repeats_hold"),
        (tokens <= F.col("budget")).alias("within_budget"),
        ((F.col("budget") == 0) | (F.col("budget") - tokens < F.col("longest_of_all"))).alias("near_budget"),
    )


QUERIES = {"p9_documents": p9_documents, "p9_shares": p9_shares, "p9_holds": p9_holds}
ORACLE = {"p9_holds": "select source, target_share, max_repeats, true as repeats_hold, true as within_budget, true as near_budget from mix_targets where source is not null"}
