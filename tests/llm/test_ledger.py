import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairweave.llm.ledger import ConcurrentUpdate, Ledger, collapse, unordered_key


def keys(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, id1 string, id2 string, ani double, cov double")
    return df.withColumn("key", unordered_key([F.col("id1"), F.col("id2")], [F.col("ani"), F.col("cov")])).selectExpr("id", "key", "1 as n_copies", "2 as first_id", "3 as bucket")


def test_forms_of_a_record(spark):
    same = [("JX_12.1", "QA_9.2", 0.5, None), ("qa 9-2", " jx121\r", 0.5, None), (">Jx–12'1", "[QA]\xa09\t2", 0.5, None)]
    other = [("JX_12.1", "QA_9.2", 0.5, 0.0), ("JX_12.1", "QA_9.3", 0.5, None), ("JX_12.1", None, 0.5, None), ("JX_12.1", "", 0.5, None), ("JX_12.1", "QA_9.2", None, 0.5), ("JX_12.1", "QA_9.2", float("nan"), None)]
    got = [r["key"] for r in keys(spark, same + other).orderBy("id").collect()]
    assert len(set(got[:3])) == 1 and len(set(got)) == 1 + len(other)
    zero = keys(spark, [("a", "b", 0.0, -0.0), ("a", "b", -0.0, 0.0)]).collect()
    assert zero[0]["key"] == zero[1]["key"]


def test_batches_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "A", "a.", "b"]), rng.choice(["c", "C!", "d", None]), rng.choice([0.1, None]), 0.5) for _ in range(300)] + [("hot", "hot", 1.0, 1.0)] * 150
    rng.shuffle(rows)
    records = keys(spark, rows)
    plain = {r["id"]: r["key"] for r in records.collect()}
    first, n = {}, Counter(plain.values())
    for i in sorted(plain):
        first.setdefault(plain[i], i)
    for batches in (1, 4):
        got = {r["id"]: (r["first_id"], r["n_copies"]) for r in collapse(records, Ledger(spark, buckets=5), batches=batches).collect()}
        assert got == {i: (first[k], n[k]) for i, k in plain.items()}


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, id long")


def counted(ledger):
    return {r["key"]: (r["n_copies"], r["first_id"]) for r in ledger.counts().collect()}


def test_other_buckets_and_longer_files_stay(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    one = Ledger(spark, path, buckets=8)
    one.update(rows_of(spark, *[(f"k{i}", 100 + i) for i in range(200)]))
    before = {b: list(f) for b, f in one.files.items()}
    two = Ledger(spark, path)
    assert two.buckets == 8 and two.files == one.files
    two.update(rows_of(spark, ("k7", 1)))
    changed = [b for b in before if two.files[b] != before[b]]
    assert len(changed) == 1 and two.files[changed[0]][:1] == before[changed[0]]  # a long file isn't rewritten
    two.update(rows_of(spark, ("k7", 2)))
    assert len(two.files[changed[0]]) == 2  # the short ones are joined
    two.update(rows_of(spark))
    assert two.number == 3
    want = {f"k{i}": (1, 100 + i) for i in range(200)} | {"k7": (3, 1)}
    assert counted(Ledger(spark, path)) == want
    two.vacuum()
    assert counted(Ledger(spark, path)) == want


def test_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    ledger = Ledger(spark, path)
    ledger.update(rows_of(spark, ("x", 5), ("y", 6), ("x", 7)))
    broken = Ledger(spark, path)
    monkeypatch.setattr(broken, "_commit", lambda files: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        broken.update(rows_of(spark, ("x", 1)))
    again = Ledger(spark, path)
    assert counted(again) == {"x": (2, 5), "y": (1, 6)}
    assert any(name.startswith("v-") for name in again.vacuum())
    again.update(rows_of(spark, ("x", 1)))
    assert counted(Ledger(spark, path)) == {"x": (3, 1), "y": (1, 6)}


def test_second_writer_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    Ledger(spark, path).update(rows_of(spark, ("x", 5)))
    one, two = Ledger(spark, path), Ledger(spark, path)
    one.update(rows_of(spark, ("x", 6)))
    with pytest.raises(ConcurrentUpdate):
        two.update(rows_of(spark, ("x", 7)))
    assert counted(Ledger(spark, path)) == {"x": (2, 5)}


def test_one_shuffle_a_side(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", buckets=4)
    ledger.update(rows_of(spark, *[(f"k{i}", i) for i in range(50)]))
    plan = ledger._read([f for files in ledger.files.values() for f, _ in files]).join(rows_of(spark).repartition(4, "key"), "key", "full_outer")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2


def test_empty(spark):
    assert collapse(keys(spark, []), Ledger(spark)).collect() == []
