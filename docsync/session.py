"""Session helpers: the shared scratch folder and its use for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Temporary folder per local session.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may leave the setting empty; it then gets a fresh temporary folder.
    On a cluster a machine-local folder would silently lose data with its executor, so that
    is an error.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="docsync-")
    return _LOCAL[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, never used path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written files.

    Used instead of caching where a result is read more than once: the files outlive
    executors, and nothing upstream is computed again.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, when the input has fewer partitions than there are cores.

    For costly per-row work on an input of few files. A large input has more partitions than
    cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the library relies on; all can be set at run time.

    * UTC, because cutover times and document times are UTC.
    * Whole-stage code above 8,000 bytes of bytecode is never compiled by the JVM and would be
      interpreted; wide document rows reach that, and run several times faster split up.
    * A join whose smaller side turns out to fit a hash table per task is not sorted.
    * Partitions of a shuffle are joined up to 8 MB only. A shuffle of ids shrinks to a few bytes a row, so that 64 MB
      (the default) is millions of ids, and a task that groups and joins them holds one hash table for each step.
    * Lists of ids reach the row groups' Bloom filters; beyond this many values a list becomes a range.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "1024")
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    return spark
