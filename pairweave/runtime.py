"""Session helpers shared by the iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, which are removed once nothing refers to them unless the session says
    otherwise, so a loop holds the files of its last rounds only.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, as in tests, gets a folder of its own;
    elsewhere a missing setting is an error, since executors can't share a machine's temporary folder.
    """
    sc = spark.sparkContext
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pairweave-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame, *, keep_partitioning: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Loops call this once a round, so that a plan never grows with the number of rounds and a lost executor costs
    one round at most. A checkpoint keeps the size estimate of the plan it came from, and a join multiplies the
    estimates of its sides, so over some rounds the number alone would fill the driver; the rows are therefore
    wrapped as a relation of unknown size, and adaptive execution goes by real sizes. ``keep_partitioning`` leaves
    the checkpoint as it is, with its estimate and with the partitioning that later joins can use.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    saved = df.checkpoint(eager=True)
    if not keep_partitioning:
        jdf = saved._jdf
        saved = DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)
    saved._is_cut = True
    return saved


def materialised(df: DataFrame, *columns: str) -> DataFrame:
    """The given columns of ``df``, which is cut first unless it was already."""
    picked = df.select(*columns) if columns else df
    return picked if getattr(df, "_is_cut", False) else cut(picked)


def derived(df: DataFrame, *columns) -> DataFrame:
    """A selection of a frame that was cut, which counts as cut as well: it is one scan of it, without a shuffle."""
    picked = df.select(*columns)
    picked._is_cut = getattr(df, "_is_cut", False)
    return picked
