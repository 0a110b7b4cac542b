"""References to records that do not exist, or not at the time of the reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphskein.plans.heavy import heavy_keys
from graphskein.plans.scratch import cut

#: Keys are cut into blocks of 2**BLOCK_BITS values, so that a block's runs and references are bounded.
BLOCK_BITS = 16


def _stacked(edges: DataFrame, fields: Sequence[str], id_col: str, time_col: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("long").alias("k")) for f in fields)))
    return edges.select(F.col(id_col).alias("row_id"), F.col(time_col).alias("at"), each.alias("r")).select("row_id", "at", F.col("r.f").alias("ref_field"), F.col("r.k").alias("uid")).where("uid is not null")


def parent_runs(parents: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Contiguous runs of the sorted keys ``id``, cut at block borders: ``blk, first, last, born_max, died_min``.

    A run also carries the latest birth and the earliest death in it: a reference made between both holds for every
    key of the run, and needs no look at the single parent.
    """
    in_order = Window.partitionBy("blk").orderBy("id")
    numbered = parents.withColumn("blk", F.shiftright("id", bits)).withColumn("island", F.col("id") - F.row_number().over(in_order))
    return numbered.groupBy("blk", "island").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max("born").alias("born_max"), F.min("died").alias("died_min")).drop("island")


def broken_references(
    edges: DataFrame, vertices: DataFrame, fields: Sequence[str] = ("subject", "objectuid"), *, id_col: str = "edge_id", time_col: str = "seen_at",
    key: str = "id", born_col: str = "created_at", died_col: str = "deleted_at", share: float = 0.001, bits: int = BLOCK_BITS,
) -> DataFrame:
    """References of ``edges`` that do not hold at the edge's time.

    Output, distinct: ``id_col``, ``ref_field``, ``reason``, ``seen_month`` ('yyyy-MM'). Reasons: 'missing' (no parent
    has the key), 'deleted' (``died_col`` <= the edge's time), 'late' (``born_col`` > the edge's time); a reference can
    be deleted and late at once and then gives two rows. A parent with null birth has always been there, one with
    null death lives. Null references and parents with a null key are left out; an edge without time can only be
    'missing', its month is then ''. If a key comes with different births or deaths, the earliest birth and the latest
    death hold. Empty tables: no edges give no rows, no parents make every reference 'missing'.

    Plan: the distinct keys of the references (combined before the shuffle, so hot keys shrink to a row per task) are
    matched as of the preceding run of parent keys, block by block; a key beyond the run's end is missing. Only keys whose
    references reach outside their run's span of life are joined to single parents. The few heavy keys are broadcast
    (``heavy_keys`` bounds their number), the rest of the references is joined to the broken keys by key.
    """
    kind = edges.schema[time_col].dataType
    low, high = F.lit("0001-01-01 00:00:00").cast(kind), F.lit("9999-12-31 23:59:59").cast(kind)
    parents = vertices.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(
        F.min(F.coalesce(F.col(born_col).cast(kind), low)).alias("born"), F.max(F.coalesce(F.col(died_col).cast(kind), high)).alias("died"))
    refs = _stacked(edges, fields, id_col, time_col)
    keys = refs.groupBy("uid").agg(F.min("at").alias("at_min"), F.max("at").alias("at_max"))

    run = F.struct("last", "born_max", "died_min")
    runs = parent_runs(parents, bits).select("blk", F.col("first").alias("k"), run.alias("run"), F.lit(None).cast(kind).alias("at_min"), F.lit(None).cast(kind).alias("at_max"), F.lit(False).alias("is_ref"))
    asked = keys.select(F.shiftright("uid", bits).alias("blk"), F.col("uid").alias("k"), F.lit(None).cast(runs.schema["run"].dataType).alias("run"), "at_min", "at_max", F.lit(True).alias("is_ref"))
    preceding = F.last("run", ignorenulls=True).over(Window.partitionBy("blk").orderBy("k", "is_ref").rowsBetween(Window.unboundedPreceding, 0))
    matched = runs.unionByName(asked).withColumn("run", preceding).where("is_ref")
    missing = F.col("run").isNull() | (F.col("k") > F.col("run.last"))
    doubtful = (F.col("at_min") < F.col("run.born_max")) | (F.col("at_max") >= F.col("run.died_min"))
    doubtful = matched.select(F.col("k").alias("uid"), "at_min", "at_max", missing.alias("missing"), F.coalesce(doubtful, F.lit(False)).alias("doubtful")).where("missing or doubtful")
    exact = doubtful.join(parents, doubtful.uid == parents.id, "left").where("missing or at_min < born or at_max >= died")
    broken = cut(exact.select("uid", "missing", "born", "died"))

    heavy = heavy_keys(refs, "uid", share)
    parts = [(refs.where(~F.col("uid").isin(heavy)) if heavy else refs).join(broken, "uid")]
    if heavy:
        parts.append(refs.where(F.col("uid").isin(heavy)).join(F.broadcast(broken.where(F.col("uid").isin(heavy))), "uid"))
    hit = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    late, dead = F.col("born") > F.col("at"), F.col("died") <= F.col("at")
    reasons = F.when(F.col("missing"), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(F.when(dead, F.lit("deleted")), F.when(late, F.lit("late")))))
    return hit.select(F.col("row_id").alias(id_col), "ref_field", F.explode(reasons).alias("reason"), F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")).alias("seen_month")).distinct()


def broken_by_month(broken: DataFrame, table: str = "dgraph_edge") -> DataFrame:
    """Broken references counted per table, field, reason and month."""
    return broken.groupBy(F.lit(table).alias("table_name"), "ref_field", "reason", "seen_month").agg(F.count("*").alias("n_refs"))
