"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from threadloom.session import shared_folder


def stored(df: DataFrame, name: str, *by: str) -> str:
    """Write ``df`` as a new table, in folders of ``by``; returns its path."""
    folder = shared_folder(df, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(folder)
    return folder


def dropped(spark: SparkSession, *folders: str) -> None:
    """Delete tables that nothing reads any more."""
    for folder in folders:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def files_of(folder: str) -> list[str]:
    """URIs of the data files of a table, in order."""
    fs, path = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    top = folder.rstrip("/")
    return sorted(top + f.path[len(path.rstrip("/")) :] for f in found if f.is_file and f.path.endswith(".parquet"))
