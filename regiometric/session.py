"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
BROADCAST_ROWS = 100_000


def spark_session(app_name: str = "regiometric", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and a UTC clock.

    Partition counts are left to adaptive execution: the initial number is an upper bound that small inputs
    coalesce down from. Pass ``conf`` entries with underscores for dots (``spark_sql_shuffle_partitions="8"``).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("_", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent the call fails on a cluster. A local master, whose tasks all run on this machine, gets
    a temporary folder with a warning; it is removed when the process ends.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL_DIRS:
        folder = tempfile.mkdtemp(prefix="regiometric-")
        warnings.warn(f"spark.checkpoint.dir is not set; intermediate tables go to {folder}", stacklevel=2)
        _remove_at_end(spark, folder)
        _LOCAL_DIRS[context.applicationId] = folder
    return _LOCAL_DIRS[context.applicationId]


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    """Have the driver's file system remove ``folder`` when it closes, which it does when the application ends."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed at the end of the application."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _remove_at_end(spark, folder)
    return folder


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as parquet below the shared folder and read it from there.

    Unlike ``checkpoint()`` this computes the rows once, and later readers can prune columns.
    """
    folder = scratch_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there, so a lost executor cannot change it."""
    return stage(df)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark an already written result for broadcast if it has few rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
