"""Duplicates hidden by formatting: an incremental ledger of canonical keys."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.operators.skew import heavy_split_join
from pairweave.runtime import cut, derived, ensure_checkpoint_dir
from pairweave.sources.tables import table

_SCHEMA = "key string, n_copies long, first_id long"
#: Keys that a bucket of a new ledger should hold.
BUCKET_KEYS = 100_000


def plain(value: Column) -> Column:
    """Letters and digits only, in lower case; null stays null."""
    return F.regexp_replace(F.lower(value), "[^\\p{L}\\p{N}]", "")


def unordered_key(parts: Sequence[Column], numbers: Sequence[Column]) -> Column:
    """Canonical key of a record: its text parts in any order, its numbers in theirs. Null equals null only.

    Parts hold letters and digits alone, so the separators can't occur in them.
    """
    sides = F.array_sort(F.array(*[F.coalesce(plain(p), F.lit("~")) for p in parts]))
    # adding zero folds the two zeros of floating point
    values = [F.coalesce((n.cast("double") + F.lit(0.0)).cast("string"), F.lit("~")) for n in numbers]
    return F.concat_ws("|", F.array_join(sides, "|"), *values)


def buckets_for(keys: int) -> int:
    """Buckets for a ledger that is expected to hold so many keys: a power of two, at least eight."""
    return 1 << max(3, (max(1, keys) // BUCKET_KEYS).bit_length())


class ConcurrentUpdate(RuntimeError):
    """Another writer has committed since this ledger was opened; nothing of the update is in force."""


class Ledger:
    """Counts per canonical key, kept as Parquet files by hash bucket in the shared folder.

    A manifest lists, for every bucket, its files from the oldest on. An update aggregates the batch, full-outer-joins
    it with the newest files of the buckets that it touches, as long as these aren't more than twice as long as what
    they are joined with, and writes one new file for each such bucket; other buckets and longer files aren't read. So
    a bucket has a few files of falling length, and a key is rewritten some log(n) times, not once per batch.

    Files never change. An update is in force when its manifest is renamed to the next number, which fails if that
    number exists: a job that dies before leaves the last manifest in force, and of two writers one is refused
    (:class:`ConcurrentUpdate`). :meth:`vacuum` removes what no manifest in force names.

    The bucket of a key is the partition that a shuffle by key sends it to, so both sides of the join and the write
    share one shuffle each. The number of buckets is set when a ledger is made, and kept.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 8):
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.number, self.files = 0, {}
        numbers = self._manifests()
        if numbers:
            self.number = numbers[-1]
            kept = json.loads(spark.read.text(self._manifest(self.number), wholetext=True).first()[0])
            self.buckets, self.files = kept["buckets"], {int(b): [tuple(f) for f in files] for b, files in kept["files"].items()}

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifest-{number:08d}.json"

    def _names(self) -> list[str]:
        folder = self._hadoop(self.path)
        return [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _manifests(self) -> list[int]:
        return sorted(int(n[9:17]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))

    def _read(self, files: Sequence[str]) -> DataFrame:
        """The counts of some files, one row per key, partitioned by bucket."""
        if not files:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/{f}" for f in files])
        return rows.repartition(self.buckets, "key").groupBy("key").agg(F.sum("n_copies").alias("n_copies"), F.min("first_id").alias("first_id"))

    def counts(self) -> DataFrame:
        """``(key, n_copies, first_id)`` over all batches so far."""
        return self._read([name for _, files in sorted(self.files.items()) for name, _ in files])

    def update(self, batch: DataFrame) -> None:
        """Add the records ``batch(key, id)``. Copies are counted before the shuffle; the smallest id represents."""
        new = cut(batch.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))
        bucket = F.pmod(F.hash("key"), F.lit(self.buckets)).cast("int")  # what a shuffle by key goes by
        touched = {r["bucket"]: r["count"] for r in new.groupBy(bucket.alias("bucket")).count().collect()}  # one row a bucket
        if not touched:
            return
        joined, files = [], {b: list(f) for b, f in self.files.items()}
        for b, size in touched.items():
            held = files.setdefault(b, [])
            while held and held[-1][1] <= 2 * size:
                name, rows = held.pop()
                joined.append(name)
                size += rows
        merged = self._read(sorted(joined)).join(new.repartition(self.buckets, "key"), "key", "full_outer").select(
            bucket.alias("bucket"),
            "key",
            (F.coalesce("n_copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_copies"),
            F.least("first_id", "first").alias("first_id"),
        )
        version = f"v-{uuid.uuid4().hex}"
        merged.write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        for r in self.spark.read.parquet(f"{self.path}/{version}").groupBy("bucket").count().collect():  # one row a bucket
            files[r["bucket"]].append((f"{version}/bucket={r['bucket']}", r["count"]))
        self._commit(files)

    def _commit(self, files: dict[int, list]) -> None:
        jvm = self.spark._jvm
        draft, goal = self._hadoop(f"{self.path}/draft-{uuid.uuid4().hex}"), self._hadoop(self._manifest(self.number + 1))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "files": files}).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, goal, none)
        except Py4JJavaError as error:
            if self._fs.exists(goal):
                raise ConcurrentUpdate(f"{self.path} was updated by another writer") from error
            raise
        self.number, self.files = self.number + 1, files

    def vacuum(self) -> list[str]:
        """Remove the files, drafts and manifests that the last manifest doesn't need; returns what was removed.

        Not to be called while another job reads an older state or writes a new one.
        """
        last = self._manifests()[-1:]
        wanted = {name.split("/")[0] for files in self.files.values() for name, _ in files} | {f"manifest-{n:08d}.json" for n in last}
        gone = [n for n in self._names() if n not in wanted]
        for n in gone:
            self._fs.delete(self._hadoop(f"{self.path}/{n}"), True)
        for files in self.files.values():
            for name, _ in files:
                version = self._hadoop(f"{self.path}/{name.split('/')[0]}")
                for f in self._fs.listStatus(version):
                    here = f"{version.getName()}/{f.getPath().getName()}"
                    if f.isDirectory() and not any(here == n for held in self.files.values() for n, _ in held):
                        self._fs.delete(f.getPath(), True)
                        gone.append(here)
        return gone


def id_ranges(records: DataFrame, id_col: str, batches: int) -> list[DataFrame]:
    """Split records into batches of consecutive ids, as if they had arrived one after the other."""
    low, high = records.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return []
    width = max(1, -(-(high - low + 1) // batches))
    return [records.filter(F.col(id_col).between(a, min(high, a + width - 1))) for a in range(low, high + 1, width)]


def collapse(records: DataFrame, ledger: Ledger, *, batches: int = 3) -> DataFrame:
    """Feed ``records(id, key)`` to the new ledger in batches and return ``(id, first_id, n_copies)`` of every record.

    Sets of one come out with themselves as first. Null keys aren't expected (see :func:`unordered_key`); ids must be
    unique. An empty table gives an empty result.
    """
    records = records.select("id", "key")
    for batch in id_ranges(records, "id", batches):
        ledger.update(batch)
    counts = cut(ledger.counts())
    total = counts.agg(F.coalesce(F.sum("n_copies"), F.lit(0)).alias("n")).first()["n"]
    return heavy_split_join(records, derived(counts, "key", "first_id", "n_copies", F.col("n_copies").alias("_n")), "key", "_n", total).select("id", "first_id", "n_copies")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "toy_links", "link_id", "id1", "id2", "ani", "cov")
    return links.select(F.col("link_id").alias("id"), unordered_key([F.col("id1"), F.col("id2")], [F.col("ani"), F.col("cov")]).alias("key"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that is a copy of an earlier one, with the first of its set."""
    records = _records(spark, folder)
    found = collapse(records, Ledger(spark, buckets=buckets_for(records.count())))
    return found.filter(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id"))


def p4_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each set of equal ones, with its number of copies."""
    records = _records(spark, folder)
    ledger = Ledger(spark, buckets=buckets_for(records.count()))
    for batch in id_ranges(records, "id", 3):
        ledger.update(batch.select("key", "id"))
    return ledger.counts().select("first_id", "n_copies")


QUERIES = {"p4_found": p4_found, "p4_collapsed": p4_collapsed}

_KEYS = r"""
with k as (select link_id, coalesce(regexp_replace(lower(id1), '[^\p{L}\p{N}]', '', 'g'), '~') as a, coalesce(regexp_replace(lower(id2), '[^\p{L}\p{N}]', '', 'g'), '~') as b, ani + 0.0 as ani, cov + 0.0 as cov from toy_links),
     s as (select link_id, min(link_id) over w as first_id, count(*) over w as n from k window w as (partition by least(a, b), greatest(a, b), ani, cov))
"""
ORACLE = {
    "p4_found": _KEYS + "select first_id, link_id as copy_id from s where link_id <> first_id",
    "p4_collapsed": _KEYS + "select first_id, n as n_copies from s where link_id = first_id",
}
