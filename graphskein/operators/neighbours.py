"""Neighbour sets and their intersections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphskein.graph import Graph


def neighbour_pairs(g: Graph, undirected: bool = False, predicate: Column | None = None) -> DataFrame:
    """``v, w``: w is an out-neighbour of v (with ``undirected`` an in-neighbour too); a set. ``predicate`` is over ``w``."""
    out = g.directed(undirected).select(F.col("src").alias("v"), F.col("dst").alias("w")).distinct()
    return out if predicate is None else out.where(predicate)


def neighbour_counts(pairs: DataFrame) -> DataFrame:
    """``v, k``: the size of each non-empty neighbour set."""
    return pairs.groupBy("v").agg(F.count("*").alias("k"))


def neighbour_sets(g: Graph, undirected: bool = False, predicate: Column | None = None) -> DataFrame:
    """``id, neighbours``: the neighbour set as a sorted array; empty for a vertex without any."""
    sets = neighbour_pairs(g, undirected, predicate).groupBy(F.col("v").alias("id")).agg(F.sort_array(F.collect_list("w")).alias("neighbours"))
    return g.ids.join(sets, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.expr("array()").cast(sets.schema["neighbours"].dataType)))


def second_neighbours(g: Graph, undirected: bool = False, predicate: Column | None = None) -> DataFrame:
    """``id, neighbour, second``: per vertex and neighbour the neighbour's own neighbours, null for one without any.

    ``predicate`` (over ``w``) holds for the first level only."""
    first = neighbour_pairs(g, undirected, predicate).select(F.col("v").alias("id"), F.col("w").alias("neighbour"))
    again = neighbour_pairs(g, undirected).select(F.col("v").alias("neighbour"), F.col("w").alias("second"))
    return first.join(again, "neighbour", "left").select("id", "neighbour", "second")


def shared_neighbours(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """``a, b, w`` for the pairs ``a, b`` and every w that is a neighbour of both in ``near(v, w)``.

    A pair's smaller neighbour set is unfolded and looked up in the other, so that the work of a pair is bounded by the
    smaller of both degrees, and a hub is looked up, not unfolded.
    """
    k = neighbour_counts(near)
    sized = pairs.join(k.select(F.col("v").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("v").alias("b"), F.col("k").alias("kb")), "b")
    first = F.col("ka") <= F.col("kb")
    turned = sized.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("v"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"))
    unfolded = turned.join(near, "v").select("a", "b", "w", F.col("other").alias("v"))
    return unfolded.join(near, ["v", "w"], "left_semi").select("a", "b", "w")


def degrees(g: Graph, undirected: bool = False) -> DataFrame:
    """``id, outDegree, inDegree`` of every vertex, zeros included; with ``undirected`` both are the number of edge ends."""
    ends = g.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(g.edges.select("dst", F.lit(0), F.lit(1)))
    count = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    out, into = (F.col("o") + F.col("i"),) * 2 if undirected else (F.col("o"), F.col("i"))
    zero = F.lit(0).cast("long")
    return g.ids.join(count, "id", "left").select("id", F.coalesce(out, zero).alias("outDegree"), F.coalesce(into, zero).alias("inDegree"))
