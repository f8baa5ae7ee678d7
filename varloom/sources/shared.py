"""Tables that cut a long lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the folder that ``spark.checkpoint.dir`` names and read it from there.

    On one machine a session without that setting gets a temporary folder; on a
    cluster the setting is needed. The files go when the driver ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="varloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/varloom/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_remove_all)
    _paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in _paths if spark is not None else ():
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone at exit
            return
