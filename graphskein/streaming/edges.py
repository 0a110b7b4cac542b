"""Streams of edges: degrees per window, and the last edge of every key as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from graphskein.operators.skew import last_by_key


def windowed_degrees(edges: DataFrame, time_col: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``window_start, id, inDegree, outDegree`` per tumbling window; edges later than ``late`` are left out by the watermark."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    at = edges.withWatermark(time_col, late).where("src is not null and dst is not null").select(time_col, ends.alias("e"))
    counted = at.groupBy(F.window(time_col, window).alias("w"), "e.id").agg(F.sum("e.i").alias("inDegree"), F.sum("e.o").alias("outDegree"))
    return counted.select(F.col("w.start").alias("window_start"), "id", "inDegree", "outDegree")


def keep_last_by_key(edges: DataFrame, fields: Sequence[str], folder: str, checkpoint: str, *, id_col: str = "edge_id", time_col: str = "seen_at") -> StreamingQuery:
    """Maintains :func:`~graphskein.operators.skew.last_by_key` of all edges so far below ``folder``, one version per batch.

    A batch is merged with the version before it and written as ``version=<batch>``; a batch run again replaces its own
    version, so each edge counts once. :func:`read_last` gives the newest."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(id_col, time_col, *fields)
        before = _version(spark, folder, number - 1)
        new = last_by_key(rows, fields, id_col=id_col, time_col=time_col, with_time=True)
        both = new if before is None else new.unionByName(before)
        last = both.groupBy("ref_field", "uid").agg(F.max(F.struct(time_col, id_col)).alias("s"))
        last.select("ref_field", "uid", F.col(f"s.{id_col}").alias(id_col), F.col(f"s.{time_col}").alias(time_col)).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return edges.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _version(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    if number < 0:
        return None
    return spark.read.parquet(f"{folder}/version={number}")


def read_last(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The table as of a batch."""
    return spark.read.parquet(f"{folder}/version={version}")
