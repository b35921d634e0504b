"""Intermediate tables, written to the folder that the driver and all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"

_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="marginalia-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local folder is made only where the setting is absent and Spark runs in one JVM."""
    if found := spark.conf.get(SHARED, None):
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{SHARED} must name a folder that the driver and all executors share")
    return _own_folder()


def swept(spark: SparkSession) -> None:
    """Spark drops a finished job's shuffle files once the driver's garbage is collected, for which a small heap gives it no cause."""
    if (jvm := getattr(spark, "_jvm", None)) is not None:
        jvm.System.gc()


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df written once as Parquet into the shared folder and read again: it is not computed twice, a lost executor loses
    nothing of it, and its lineage ends there. A reader of one value of column by reads the files of that value alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/marginalia/{tag}-{uuid.uuid4().hex}"
    (df.repartition(by) if by else df).write.option("compression", "zstd").parquet(path, partitionBy=by)
    swept(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def freed(*tables: DataFrame) -> None:
    """Deletes the folders of tables that stored() returned. For tables whose last reader has written its own result: nothing
    computed from them later may be read again."""
    for df in tables:
        path, jvm = _FOLDERS.pop(df, None), getattr(df.sparkSession, "_jvm", None)
        if path and jvm is not None:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
