"""Session helpers: a local test session and the reliable checkpoint folder."""

import math
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores="*", shuffle_partitions=8, memory="8g"):
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wirewarden")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such
    a folder would be lost with the machine that holds it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


# folders of the tables stored inside ``passing_tables``, by thread
_scope = threading.local()


@contextmanager
def passing_tables(spark: SparkSession):
    """What the thread stores or cuts inside goes at the end, and so do its shuffle files; nothing made
    inside may be read later. What is cut is stored by columns, as a checkpoint's files can't be told."""
    outer, _scope.folders = getattr(_scope, "folders", None), []
    try:
        yield
    finally:
        folders, _scope.folders = _scope.folders, outer
        for folder in folders:
            discard(spark, folder)
        collect_garbage(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the checkpoint folder and drop its lineage."""
    if getattr(_scope, "folders", None) is not None:
        return stored(df, "cut")
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal few partitions out to all cores before work that is heavy per row.

    Only small inputs have fewer partitions than the cluster has cores; a large
    one is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A table whose rows few tasks would read, dealt out to all cores by ``key``.

    A file is divided by bytes, but a row group is read by one task: a large file may have
    as many partitions as there are cores and all its rows in a few. Counting the rows of
    each reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    most, rows = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return df if not rows or most * cores < 1.5 * rows else df.repartition(max(cores, df.rdd.getNumPartitions()), key)


def work_partitions(spark: SparkSession, work: float, per_task: float) -> int:
    """Partitions for a stage whose cost is not its bytes, so that coalescing by
    bytes would be wrong: by amount of work, at least one per core, at most
    the session's shuffle partitions."""
    cores = spark.sparkContext.defaultParallelism
    most = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(most, max(cores, math.ceil(work / per_task)))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for a table written by a job."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the checkpoint folder, as a table by columns."""
    path = shared_path(df.sparkSession, name)
    if getattr(_scope, "folders", None) is not None:
        _scope.folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str):
    """Delete a table below the checkpoint folder that nothing will read again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def collect_garbage(spark: SparkSession):
    """Let go of shuffle files that no plan can read any more: Spark deletes them only once the
    driver's JVM has collected their plans, which it may not do before the disks are full."""
    spark.sparkContext._jvm.System.gc()
