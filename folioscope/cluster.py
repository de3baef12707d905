"""Helpers that keep a plan cluster-safe: shared folders, table reads, task counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one named by ``spark.checkpoint.dir``.  Only where that is unset (local tests) is a
    folder of this machine chosen, and set as the checkpoint folder.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        conf = held.get() if held.isDefined() else None
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="folioscope-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of any executor, and lets several
    branches reuse one result without computing it again.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/folioscope-{spark.sparkContext.applicationId}"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)  # with the application, not before: results may read it lazily
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Hash-partition by ``keys`` if the scan has fewer partitions than the cluster has cores (or
    than ``least``).

    Used in front of CPU-heavy Python stages only; a scan that already has enough splits is left
    alone, so no shuffle is added at scale.
    """
    cores = max(df.sparkSession.sparkContext.defaultParallelism, least)
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *keys)


#: Rows of a narrow table (an id or key, perhaps a number) that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted and found small, else as it is, so that the
    join shuffles.  Give it a materialised table with few narrow columns."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
