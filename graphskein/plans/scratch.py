"""Lineage cuts that survive the loss of an executor.

A cut writes a Parquet table below ``spark.checkpoint.dir`` and reads it back. That folder is shared by all
executors, the table is compressed and columnar, and its size on disk is what Catalyst and AQE use to choose joins.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_live: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cuts: ``spark.checkpoint.dir``, or a temporary one in a single-process session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = by_call.get() if by_call.isDefined() else None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="graphskein-"))
    _live[made] = spark
    return made


def cut(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """``df``, computed once and stored. The stored table is removed by :func:`drop` or at exit."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    _live[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def counted(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
    """:func:`cut`, and aggregates over the rows, computed while they are written."""
    seen = Observation()
    return cut(df.observe(seen, *(c.alias(n) for n, c in aggregates.items()))), seen.get


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that nothing refers to any more. Executors keep them until the driver's garbage
    is collected, which a driver that has little to do puts off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*dfs: DataFrame | None) -> None:
    """Remove the tables behind cuts that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "_cut_path", None):
            _remove(path)


def clear() -> None:
    """Remove the tables behind all cuts made so far; results that were not yet stored elsewhere can no longer be read."""
    for path in list(_live):
        if "/cut-" in path:
            _remove(path)


def _remove(path: str) -> None:
    spark = _live.pop(path, None)
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already; a folder elsewhere is then the cluster's to clean
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


@atexit.register
def _remove_all() -> None:
    for path in list(_live):
        _remove(path)
