"""Scratch tables in the folder that driver and executors share; they go when the driver ends."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of each running application's scratch tables.
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one with a local master, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terracell-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which is deleted when the driver ends."""
    run = spark.sparkContext.applicationId
    if run not in _FOLDERS:
        path = f"{shared_dir(spark)}/terracell-{run}-{uuid.uuid4().hex}"
        files, where = _at(spark, path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _FOLDERS[run] = path
    return f"{_FOLDERS[run]}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table, wherever the shared folder is."""
    files, where = _at(spark, path)
    files.delete(where, True)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes a table in the shared folder and reads it again, which cuts its lineage; its path is in `terracell_path`."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.terracell_path = path
    return out
