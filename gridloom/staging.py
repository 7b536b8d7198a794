"""Tables written to the folder that all executors share, so that iterations start from files and survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. Only a local master may leave that unset and gets a folder of its own machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "gridloom-shared")
    return f"{base.rstrip('/')}/gridloom/{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back. The table stays until release() or the end of the program."""
    folder = shared_dir(df.sparkSession)
    df.write.parquet(f"{folder}/{name}")
    _written[folder] = df.sparkSession
    back = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    back._staged_in = folder
    return back


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*staged: DataFrame) -> None:
    """Delete tables that stage() returned and that nothing reads any more: what was made of them is staged itself."""
    for df in staged:
        folder = df._staged_in
        if folder in _written:
            _delete(_written.pop(folder), folder)


@atexit.register
def _release_all() -> None:
    for folder, spark in _written.items():
        try:
            _delete(spark, folder)
        except Exception:  # noqa: BLE001 - the session may be stopped already; the shared folder's owner cleans up then
            return
