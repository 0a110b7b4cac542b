"""Per-key results when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphskein.plans.heavy import heavy_keys


def salted_aggregate(df: DataFrame, keys: Sequence[str], partials: Sequence[Column], merges: Sequence[Column], *, salt_by: str, spread_by: Sequence[str], salts: int = 32, share: float = 0.001) -> DataFrame:
    """Two-stage aggregation: partial results per key and salt, merged by the original key.

    ``salt_by`` is the integer key column searched for heavy values. Rows of a heavy value get one of ``salts`` salts
    by a hash of ``spread_by`` (the same for a row whenever a task is run again); all others get salt 0, so light keys
    cost no more than in a plain aggregation. ``partials`` aggregate rows, ``merges`` aggregate the partials' columns.
    A null key is a key like any other; no rows give no rows.
    """
    heavy = heavy_keys(df, salt_by, share)
    salt = F.when(F.col(salt_by).isin(heavy), F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(F.lit(0)) if heavy else F.lit(0)
    name = "_salt"
    while name in df.columns:
        name += "_"
    partial = df.withColumn(name, salt.cast("int")).groupBy(*keys, name).agg(*partials)
    return partial.groupBy(*keys).agg(*merges)


def last_by_key(df: DataFrame, fields: Sequence[str], *, id_col: str = "edge_id", time_col: str = "seen_at", salts: int = 32, share: float = 0.001, with_time: bool = False) -> DataFrame:
    """For each column of ``fields`` and each non-null value in it: the row of greatest ``time_col``, then ``id_col``.

    Output: ``ref_field`` (name of the column), ``uid`` (its value), ``id_col``, and ``time_col`` ``with_time``. A row whose time is null counts as
    earlier than any other, one whose id is null as before any other id of its time. Repeated rows change nothing;
    further columns are ignored, whatever their names; an empty table gives no rows.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("ref_field"), F.col(f).cast("long").alias("uid")) for f in fields)))
    long = df.select(each.alias("_r"), F.col(time_col).alias("_at"), F.col(id_col).alias("_id")).select("_r.ref_field", "_r.uid", "_at", "_id").where("uid is not null")
    last = F.max(F.struct("_at", "_id"))
    out = salted_aggregate(long, ["ref_field", "uid"], [last.alias("_last")], [F.max("_last").alias("_last")], salt_by="uid", spread_by=["_id", "_at"], salts=salts, share=share)
    return out.select("ref_field", "uid", F.col("_last._id").alias(id_col), *([F.col("_last._at").alias(time_col)] if with_time else []))


def key_summary(df: DataFrame, fields: Sequence[str], *, time_col: str = "seen_at", salts: int = 32, share: float = 0.001) -> DataFrame:
    """Rows, first and last time of each non-null value of each column of ``fields``, by the same two stages.

    Output: ``ref_field``, ``uid``, ``n_rows``, ``first_at``, ``last_at`` (null if no row of the key has a time).
    Rows count as often as they stand in the table.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("ref_field"), F.col(f).cast("long").alias("uid")) for f in fields)))
    long = df.select(each.alias("_r"), F.col(time_col).alias("_at")).select("_r.ref_field", "_r.uid", "_at").where("uid is not null")
    return salted_aggregate(
        long, ["ref_field", "uid"], [F.count("*").alias("n_rows"), F.min("_at").alias("first_at"), F.max("_at").alias("last_at")],
        [F.sum("n_rows").alias("n_rows"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")], salt_by="uid", spread_by=["_at"], salts=salts, share=share,
    )
