"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on, plus the ones that keep hot keys spread out.
# All of them can be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on a hot key is split even when that costs one more shuffle for
    # the aggregation above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sort-based fallback of percentile/collect_list after this many keys per
    # task; the default of 128 makes ordinary per-query aggregation sort.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = 8, app_name: str = "lapwise") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("LAPWISE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for a time."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for state, checkpoints or cut lineage.

    The cluster names the shared folder in ``spark.checkpoint.dir``.  Only a
    local master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="lapwise-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows from a table written to the shared folder.

    For results that several later steps read: they are computed once, survive
    lost executors, and carry their size for join planning.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what ``cut`` writes inside, once results that rest on it are stored.

    For work that is done again and again, such as the batches of a stream.
    """
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.remove(paths)
        for path in paths:
            remove_folder(spark, path)


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    folder, store = hadoop_path(spark, path)
    store.delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder, store = hadoop_path(spark, path)
    return store.exists(folder)
