"""Single linkage kept current over a stream of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairweave.operators.components import connected_components


class GroupStore:
    """``(id, root)`` of all objects seen, one Parquet version per micro-batch; the last finished one is in force."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [x.getPath() for x in fs.listStatus(root) if fs.exists(hadoop.Path(x.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def labels(self, before: int | None = None) -> DataFrame:
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], "id string, root string")
        return self.spark.read.schema("id string, root string").parquet(f"{self.path}/{known[-1]}")

    def add(self, pairs: DataFrame, batch_id: int) -> None:
        """Fold a batch of ``pairs(src, dst)`` into the groups. A batch that is sent again gives the same version.

        Old groups enter as one edge per object to its root, so each batch costs one solve over the labels and the
        new pairs, never over all pairs so far.
        """
        old = self.labels(before=batch_id)
        new = pairs.filter("src is not null and dst is not null and src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        known = old.filter("id <> root").select(F.least("id", "root").alias("src"), F.greatest("id", "root").alias("dst"))
        connected_components(known.unionByName(new).distinct()).write.mode("overwrite").parquet(f"{self.path}/{batch_id}")


def keep_groups(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that folds every micro-batch of a streaming ``pairs(src, dst)`` into the store at ``path``."""
    store = GroupStore(pairs.sparkSession, path)
    return pairs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store.add).start()
