"""Keys that hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with fewer rows than this is left as it is.
LEAST_ROWS = 100_000


def heavy_keys(df: DataFrame, key: str, share: float = 0.001, tracked: int = 4096) -> list[int]:
    """Every integer key that holds at least ``share`` of the non-null rows; possibly a few lighter ones too.

    Frequent-item summaries (Misra-Gries) with ``tracked`` counters are built over all rows of each partition and
    merged. A summary undercounts a key by at most rows/(tracked+1), so a key of ``share`` is always kept when
    ``share > 1/(tracked+1)``. At most ``1/(share - 1/(tracked+1))`` keys can come out, whatever the input's size;
    this bounds what the driver and later broadcasts hold. No rows: no keys.
    """
    if share <= 1 / (tracked + 1):
        raise ValueError("share must exceed 1 / (tracked + 1)")

    def shrink(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(keys) > tracked:
            counts = counts - np.partition(counts, -tracked - 1)[-tracked - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        return keys, counts

    def add(keys: np.ndarray, counts: np.ndarray, k2: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both, at = np.unique(np.concatenate([keys, k2]), return_inverse=True)
        return shrink(both, np.bincount(at, np.concatenate([counts, c2]), len(both)).astype(np.int64))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b in batches:
            values = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            rows += len(values)
            keys, counts = add(keys, counts, *np.unique(values, return_counts=True))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, 0)), pa.array(np.append(counts, rows)), pa.array(np.append(np.zeros(len(keys), bool), True))], ["k", "n", "total"])

    def merged(last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, counts, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            for b in batches:
                k, n, total = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                rows += int(n[total].sum())
                keys, counts = add(keys, counts, k[~total], n[~total])
            if last:
                keep = counts >= rows * (share - 1 / (tracked + 1))
                keys, counts = keys[keep], counts[keep]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, 0)), pa.array(np.append(counts, rows)), pa.array(np.append(np.zeros(len(keys), bool), True))], ["k", "n", "total"])

        return merge

    kind = "k long, n long, total boolean"
    parts = df.select(F.col(key).cast("long").alias("k")).mapInArrow(summarise, kind)
    level = parts.repartition(64, F.spark_partition_id()).mapInArrow(merged(False), kind)  # so the last task reads 64 summaries
    return [r.k for r in level.repartition(1).mapInArrow(merged(True), kind).where("not total").collect()]


def hot_keys(rows: DataFrame, key: str, n: int | None = None, share: float = 0.001, least: int = LEAST_ROWS) -> list:
    """The keys that hold at least ``share`` of the ``n`` rows and at least ``least`` rows: at most 1/share, whatever their type.

    Counted exactly, combined before the shuffle. Fewer than ``least`` rows have no such key and are not counted."""
    if n is None:
        n = rows.count()
    if n < least:
        return []
    return [r[0] for r in rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(least, int(share * n))).select(key).collect()]


def salted(key: Column, hot: list, by: Column, salts: int) -> Column:
    """The salt of a row: a hash of ``by`` for hot keys, else 0."""
    return F.when(key.isin(hot), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int") if hot else F.lit(0)


def all_salts(key: Column, hot: list, salts: int) -> Column:
    """The array of the salts that rows of a key can have."""
    return F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))


def look_up(rows: DataFrame, table: DataFrame, key: str, by: str, hot: list, salts: int = 32, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key``; rows of hot keys are spread by a hash of their column ``by``."""
    if not hot:
        return rows.join(table, key, how)
    spread = table.withColumn("_salt", F.explode(all_salts(F.col(key), hot, salts)))
    return rows.withColumn("_salt", salted(F.col(key), hot, F.col(by), salts)).join(spread, [key, "_salt"], how).drop("_salt")
