import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairweave.llm.mixing import TOKENIZERS, mixture, quality, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


def documents(spark):
    rows = [(i, ("big", "big", "big", "small", "mid", "unlisted", None)[i % 7], "some words of text number %d " % i * (1 + i % 5)) for i in range(700)]
    rows += [(10_000, "big", None), (10_001, "big", ""), (10_002, "small", "word " * 3000)]
    return spark.createDataFrame(rows, "id long, source string, text string").withColumns({"quality": quality(F.col("text")), "n_tokens": F.lit(0), "draw": F.lit(0)})


def targets(spark, rows=(("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.15, 2), ("gone", 0.05, 2), ("off", 0.0, 0))):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int").withColumns({"available": F.lit(7), "budget": F.lit(8)})


def test_shares_caps_and_epochs(spark):
    docs = documents(spark)
    sizes = {r["id"]: (r["source"], r["n_tokens"]) for r in token_counts(docs).collect()}
    taken, report = mixture(docs, targets(spark))
    rows, shares = taken.collect(), {r["source"]: r for r in report.collect()}
    assert set(shares) == {"big", "small", "mid", "gone", "off"}
    per, most = defaultdict(int), defaultdict(int)
    for r in rows:
        assert sizes[r["id"]] == (r["source"], r["n_tokens"]) and r["n_tokens"] > 0
        per[r["source"]] += r["n_tokens"] * r["repeats"]
        most[r["source"]] = max(most[r["source"]], r["repeats"])
    for s, r in shares.items():
        longest = max((n for x, n in sizes.values() if x == s), default=0)
        assert per[s] == r["reached"] and most[s] == r["most_repeats"] <= max(1, r["max_repeats"])
        assert r["budget"] - longest < r["reached"] <= r["budget"] or r["budget"] == 0 == r["reached"]
        if r["epochs"]:
            assert {x["id"] for x in rows if x["source"] == s} == {i for i, (x, n) in sizes.items() if x == s and n}
    total = sum(per.values())
    assert abs(shares["big"]["reached_share"] - per["big"] / total) < 1e-6
    assert shares["gone"]["reached"] == 0 == shares["off"]["reached"]


def test_total_may_be_given_and_exceed_the_caps(spark):
    shares = {r["source"]: r for r in mixture(documents(spark), targets(spark), total_tokens=10**9)[1].collect()}
    for s in ("big", "small", "mid"):
        assert shares[s]["reached"] == shares[s]["available"] * shares[s]["max_repeats"] == shares[s]["budget"]
    few = mixture(documents(spark), targets(spark), total_tokens=0)
    assert few[0].collect() == []


def test_same_seed_same_sample_whatever_the_partitions(spark):
    docs = documents(spark)
    one = sorted(map(tuple, mixture(docs, targets(spark))[0].collect()))
    two = sorted(map(tuple, mixture(docs.repartition(9), targets(spark))[0].collect()))
    other = sorted(map(tuple, mixture(docs, targets(spark), seed=2)[0].collect()))
    assert one == two != other


def test_better_documents_are_drawn_more_often(spark):
    docs = spark.createDataFrame([(i, "s", "ten words of text that all weigh the same here", 1.0 if i % 2 else 0.1) for i in range(2000)], "id long, source string, text string, quality double")
    docs = docs.unionByName(docs.select((F.col("id") + 5000).alias("id"), F.lit("t").alias("source"), "text", "quality").limit(100))
    taken = mixture(docs, targets(spark, [("s", 0.5, 1), ("t", 0.5, 1)]))[0].filter("source = 's'").collect()
    assert sum(r["id"] % 2 for r in taken) > 0.75 * len(taken)


def test_empty(spark):
    taken, report = mixture(documents(spark).limit(0), targets(spark))
    assert taken.collect() == [] and all(r["reached"] == 0 for r in report.collect())
    assert mixture(documents(spark), targets(spark).limit(0))[0].collect() == []
