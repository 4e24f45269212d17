"""Session helpers: a builder for local use and the shared folder of a cluster."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# An input of fewer splits than this (of 128 MB at most) is small enough to be shuffled.
FEW_SPLITS = 64


def build_session(cores: str = "*", app: str = "jobloom", **conf: str) -> SparkSession:
    """A local session; on a cluster use the session the cluster gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("JOBLOOM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Give a small input to all cores.

    A file of one row group is one task however much work follows, though it may count as
    several splits. An input with as many splits as cores, or with many at all, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= min(cores, FEW_SPLITS):
        return df
    return df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of this machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="run-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has been written to yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder made by ``new_path``, wherever it lies; one that is gone already is fine."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_exchanges(spark: SparkSession) -> None:
    """Let Spark remove the exchanges of jobs that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
