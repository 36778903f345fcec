from collections import defaultdict

from pairweave.streaming.incremental import GroupStore, keep_groups


def parts(store):
    out = defaultdict(set)
    for r in store.labels().collect():
        out[r["root"]].add(r["id"])
    return sorted(map(sorted, out.values()))


def test_groups_follow_the_stream(spark, tmp_path):
    src, path = tmp_path / "in", f"file://{tmp_path}/groups"
    batches = [[("a", "b"), ("c", "d"), (None, "x"), ("y", "y")], [("b", "e"), ("f", "g")], [("d", "a")]]
    want = [[["a", "b"], ["c", "d"]], [["a", "b", "e"], ["c", "d"], ["f", "g"]], [["a", "b", "c", "d", "e"], ["f", "g"]]]
    store = GroupStore(spark, path)
    assert store.labels().collect() == []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "src string, dst string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("src string, dst string").parquet(str(src))
        query = keep_groups(stream, path, f"{tmp_path}/check")
        query.processAllAvailable()
        query.stop()
        assert parts(store) == want[k]
    store.add(spark.createDataFrame(batches[2], "src string, dst string"), 2)
    assert parts(store) == want[2]
