"""Session helpers: checkpoint folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side may hold this many rows and estimated bytes at most.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


_OWN_FOLDERS: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where it is unset (tests), a fresh local one per session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        shared = _OWN_FOLDERS.get(spark.sparkContext.applicationId)
    if not shared:
        shared = _OWN_FOLDERS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="graphloom-shared-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return shared.rstrip("/")


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: lineage ends here and survives the loss of executors.

    Unlike ``checkpoint()`` this computes ``df`` once, keeps columns prunable and
    gives the optimizer the true size (a checkpoint hands on the estimate, which
    loops of joins square with every round). ``done`` are earlier results of
    ``cut`` that nothing reads any more; their files are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in done:
        if old_path := getattr(old, "_graphloom_path", None):
            target = spark._jvm.org.apache.hadoop.fs.Path(old_path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def remove_tables(spark: SparkSession) -> int:
    """Delete all tables that ``cut`` wrote in this process; call it when no result is read any more."""
    n = len(_WRITTEN)
    while _WRITTEN:
        target = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return n


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows and text sizes stay under the bound, else plain.

    ``df`` is written once (see ``cut``), so that counting doesn't compute it twice; beyond
    the bound the join falls back to Spark's shuffled joins (AQE splits skew).
    """
    df = cut(df)
    width = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(16 * len(df.columns)))
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, over at least as many partitions as there are cores; many-file tables pass unchanged.

    Parsing costs far more than reading, and a small table may be one row group.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def local_session(cores: str = "*", app: str = "graphloom", partitions: int = 8) -> SparkSession:
    """Session for tests and benches in one JVM."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="graphloom-shared-"))
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
