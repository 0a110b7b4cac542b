"""The N best items of every group, by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_n(n: int):
    """Keeps the first ``n`` rows of each group of a partition that is sorted by group. Of a group that goes on from
    the last batch, only its key and the number of rows seen so far are remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0)
            changed = np.ones(b.num_rows, bool)
            if b.num_rows > 1:
                changed[1:] = pc.fill_null(pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)), True).to_numpy(zero_copy_only=False)
            first = g[0].as_py()
            changed[0] = last is None or first != last
            start = np.maximum.accumulate(np.where(changed, np.arange(b.num_rows), -1))
            rank = np.where(start >= 0, np.arange(b.num_rows) - start, np.arange(b.num_rows) + seen)
            keep = b.filter(pa.array(rank < n))
            last, seen = g[b.num_rows - 1].as_py(), int(rank[-1]) + 1
            if keep.num_rows:
                yield keep

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, *, salts: int = 16) -> DataFrame:
    """The ``n`` rows of highest ``score`` in each ``group``, ties by smaller ``item``: ``group, item, score``.

    Rows with a null group, item or score, or a NaN score, are left out; infinity is a score like any other. Repeated
    rows (same group, item and score) count once; an item with several scores stands once for each. Fewer than ``n``
    rows in a group: all of them. Further columns are ignored; an empty table gives no rows.

    Plan: hash partitions by group and salt, each sorted by group, score and item, are streamed as Arrow batches of
    which the first ``n`` rows of a group pass; then the same by group alone, over at most ``n * salts`` rows a group.
    A group with a third of all rows is thus spread over ``salts`` tasks, and none holds a group in memory.
    """
    if n < 1:
        raise ValueError("n must be positive")
    g, i, s = F.col(f"`{group}`"), F.col(f"`{item}`"), F.col(f"`{score}`")
    rows = df.where(g.isNotNull() & i.isNotNull() & s.isNotNull()).select(g.alias("g"), i.alias("i"), s.alias("s"))
    if dict(rows.dtypes)["s"] in ("double", "float"):
        rows = rows.where(~F.isnan("s"))
    order = ["g", F.desc("s"), "i"]
    kind = rows.schema
    spread = rows.repartition("g", F.pmod(F.xxhash64("i"), F.lit(salts))).sortWithinPartitions(*order)
    some = spread.mapInArrow(_distinct, kind).mapInArrow(_first_n(n), kind)
    best = some.repartition("g").sortWithinPartitions(*order).mapInArrow(_first_n(n), kind)
    return best.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves out rows equal to the one before; equal rows are neighbours, as they share group, salt, score and item."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.ones(b.num_rows, bool)
        if b.num_rows > 1:
            new[1:] = False
            for c in b.columns:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or last != tuple(c[0].as_py() for c in b.columns)
        last = tuple(c[b.num_rows - 1].as_py() for c in b.columns)
        yield b.filter(pa.array(new))


def latest(df: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Of each ``key`` the ``value`` of greatest ``at`` (null is earliest), ties by greatest value: ``key, value``."""
    return df.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))).alias("s")).select(key, F.col("s.v").alias(value))


def top_vertices(communities: DataFrame, measures: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` vertices of highest measure in each community, from results of several runs.

    Rows with a null vertex or community, or a null or NaN measure, are left out; then of each vertex the row of
    greatest ``computed_at`` counts in either table (ties: greatest community, greatest measure).
    """
    of = latest(communities.where("vertex is not null and community is not null"), "vertex", "community", "computed_at")
    by = latest(measures.where("vertex is not null and measure is not null and not isnan(measure)"), "vertex", "measure", "computed_at")
    return top_n(of.join(by, "vertex"), "community", "vertex", "measure", n)
