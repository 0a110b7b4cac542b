"""Link prediction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.operators.neighbours import neighbour_counts, neighbour_pairs


def two_hop_pairs(near: DataFrame) -> DataFrame:
    """``a, b, w`` for every ordered pair a <> b with a common neighbour w in ``near(v, w)``."""
    a, b = near.select(F.col("v").alias("a"), "w"), near.select(F.col("v").alias("b"), "w")
    return a.join(b, "w").where("a <> b")


def common_count(near: DataFrame) -> DataFrame:
    """``a, b, measure``: the number of common neighbours of pairs that have any."""
    return two_hop_pairs(near).groupBy("a", "b").agg(F.count("*").cast("double").alias("measure"))


def adamic_adar_sum(near: DataFrame) -> DataFrame:
    """``a, b, measure``: the sum of 1 / ln(number of neighbours) over common neighbours of pairs that have any."""
    k = neighbour_counts(near).select(F.col("v").alias("w"), "k")
    term = F.when(F.col("k").isNull(), 0.0).when(F.col("k") == 1, float("inf")).otherwise(1.0 / F.log(F.col("k").cast("double")))
    return two_hop_pairs(near).join(k, "w", "left").groupBy("a", "b").agg(F.sum(term).alias("measure"))


def predict_links(g: Graph, measure: Callable[[DataFrame], DataFrame] = common_count, threshold: float = 0.0, undirected: bool = False) -> DataFrame:
    """``src, dst`` of all pairs whose measure exceeds ``threshold`` and that no edge joins yet.

    ``measure(near)`` gives ``a, b, measure`` of the pairs with a common neighbour; all others have 0, so a threshold below 0 is refused.
    With ``undirected`` neighbours are those of both directions, an edge in either direction counts, and each pair comes once, smaller id first."""
    if threshold < 0:
        raise ValueError("threshold must not be negative: pairs without common neighbours are not enumerated")
    near = neighbour_pairs(g, undirected)
    pairs = measure(near).where(F.col("measure") > threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if undirected:
        pairs = pairs.where("src < dst")
    known = g.directed(undirected).select("src", "dst").distinct()
    return pairs.join(known, ["src", "dst"], "left_anti")
