"""Scratch tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; it is deleted when the driver ends.

    A temporary folder of this machine stands in where that is unset, on a local master only.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        folder = f"{root.rstrip('/')}/scratch-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[app] = folder
    return _FOLDERS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back; lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
