"""Tables written in the cluster's shared folder, to cut lineage and reuse results.

A staged table is ordinary Parquet under ``spark.checkpoint.dir``; it survives the
loss of any executor. Without that setting a temporary folder of the driver's machine
serves a local master, which is removed when the process ends; a cluster is refused,
as its executors would write where no one else reads.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def workspace(spark: SparkSession) -> str:
    """The shared folder for this application's staged tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"
    if not is_local(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lodestone-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def is_local(master: str) -> bool:
    """Whether executors are threads of the driver."""
    return master == "local" or master.startswith("local[")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unstaged(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if "staged_at" in vars(df):
            _delete(df.sparkSession, df.staged_at)


def purge(spark: SparkSession) -> None:
    """Remove every table that this application staged, once its results are written."""
    _delete(spark, workspace(spark))
