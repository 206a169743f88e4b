"""Paths for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors share, deleted when the application ends.

    Where that is unset: a local folder if everything runs in one process, as in tests, and an error on a cluster."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spanlens-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        root = _LOCAL[app]
    own = f"{root}/spanlens/{app}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once however often it is used, with a short plan, and safe from a
    lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
