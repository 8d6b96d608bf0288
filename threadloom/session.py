"""Session helpers: a local session for tests, table loading, lineage cuts in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("threadloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _set_folder(df: DataFrame) -> None:
    """Name the checkpoint folder where the session hasn't: that of ``spark.checkpoint.dir``, or a temporary one if the master is local."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), f"threadloom-{uuid.uuid4().hex}")
        sc.setCheckpointDir(shared)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the folder of ``spark.checkpoint.dir``.

    Only where the session has none and the master is local is a temporary one set; a
    cluster without a shared folder is an error, since a machine-local folder would not
    survive a lost executor.
    """
    _set_folder(df)
    return df.checkpoint(eager=True)


def shared_folder(df: DataFrame, name: str) -> str:
    """A new path in the folder that all executors share."""
    _set_folder(df)
    return f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def drop_checkpoints(spark: SparkSession) -> None:
    """Delete this session's checkpoints and shared tables, once no DataFrame needs them.

    A session with ``spark.cleaner.referenceTracking.cleanCheckpoints`` cleans checkpoints by itself.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held.get())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
