"""Eigenvector centrality, hubs and authorities, PageRank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.operators.paths import _check_landmarks
from graphskein.plans.fixpoint import Loop
from graphskein.plans.scratch import cut


def eigenvector(
    g: Graph, *, undirected: bool = False, weight: str | None = None, tol: float = 1e-6, max_iter: int = 100, go_on: Callable[[int, float, float], bool] | None = None
) -> DataFrame:
    """Vertices with ``measure`` by power iteration from 1/n: the weighted sum over in-edges, divided by the L2 norm.

    Stops when the mean changes by at most ``tol``, or after ``max_iter`` rounds, or when ``go_on(round, old mean, new
    mean)`` says so. All zero when the norm is (any graph without cycles)."""
    e = cut(g.directed(undirected, weight).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    ids = cut(g.ids)
    n = ids.count()
    if not n:
        return g.with_measure(ids.select("id", F.lit(0.0).alias("measure")), {"measure": 0.0})
    loop, state, mean, scale = Loop(), ids.withColumn("x", F.lit(1.0 / n)), 1.0 / n, 1.0
    for now in range(1, max_iter + 1):
        into = state.withColumnRenamed("id", "src").join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w") * scale).alias("y"))
        new = ids.join(into, "id", "left").select("id", F.coalesce("y", F.lit(0.0)).alias("x"))
        state, row = loop.keep(new, F.sum("x").alias("s"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        scale = 1.0 / row.norm if row.norm else 1.0  # the norm is applied where the state is read next
        before, mean = mean, row.s * scale / n
        if not (abs(mean - before) > tol if go_on is None else go_on(now, before, mean)):
            break
    return g.with_measure(state.select("id", (F.col("x") * scale).alias("measure")), {"measure": 0.0})


def hits(g: Graph, *, normalize: bool = True, tol: float = 1e-8, max_iter: int = 100) -> DataFrame:
    """Vertices with ``authority`` and ``hub``, both from 1/n.

    A round gives every vertex the sum of hubs over in-edges and the sum of the *former* authorities over out-edges, each
    divided by its greatest. Stops when the mean hub changes by at most ``tol`` or after ``max_iter`` rounds; then, with
    ``normalize``, each is divided by its sum. Without edges both are 0."""
    e = g.edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    # both directions in one table, so that a round reads the state once
    ways = cut(e.select("src", "dst", F.lit(True).alias("forth"), "w").unionAll(e.select("dst", "src", F.lit(False), "w")).toDF("from", "to", "forth", "w"))
    ids = cut(g.ids)
    n = ids.count()
    loop, state, mean = Loop(), ids.select("id", F.lit(1.0 / max(n, 1)).alias("a"), F.lit(1.0 / max(n, 1)).alias("h")), 1.0 / max(n, 1)
    top_a = top_h = 1.0
    row = None
    for _ in range(max_iter):
        sent = state.withColumnRenamed("id", "from").join(ways, "from")
        got = sent.groupBy(F.col("to").alias("id")).agg(F.sum(F.when(F.col("forth"), F.col("h") * F.col("w") / top_h)).alias("a"), F.sum(F.when(~F.col("forth"), F.col("a") * F.col("w") / top_a)).alias("h"))
        new = ids.join(got, "id", "left").select("id", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("h", F.lit(0.0)).alias("h"))
        state, row = loop.keep(new, F.sum("a").alias("sa"), F.sum("h").alias("sh"), F.max("a").alias("ma"), F.max("h").alias("mh"))
        top_a, top_h = row.ma or 1.0, row.mh or 1.0  # applied where the state is read next
        before, mean = mean, (row.sh or 0.0) / top_h / max(n, 1)
        if abs(mean - before) <= tol:
            break
    divide_a, divide_h = ((row.sa or 1.0, row.sh or 1.0) if normalize else (top_a, top_h)) if row else (1.0, 1.0)
    return g.with_measure(state.select("id", (F.col("a") / divide_a).alias("authority"), (F.col("h") / divide_h).alias("hub")), {"authority": 0.0, "hub": 0.0})


def page_rank(g: Graph, max_iter: int = 20, reset_probability: float = 0.15, weight: str | None = None) -> DataFrame:
    """Vertices with ``pagerank``: from 1.0, ``max_iter`` rounds of reset + (1 - reset) * the sum over in-edges of rank * share
    of the source's outgoing weight; finally scaled so that the ranks sum to the number of vertices."""
    e = g.weighted(weight).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("out"))
    e = cut(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")))
    ids = cut(g.ids)
    loop, state, row = Loop(), ids.withColumn("r", F.lit(1.0)), None
    for _ in range(max_iter):
        into = state.withColumnRenamed("id", "src").join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("p")).alias("m"))
        new = ids.join(into, "id", "left").select("id", (reset_probability + (1 - reset_probability) * F.coalesce("m", F.lit(0.0))).alias("r"))
        state, row = loop.keep(new, F.sum("r").alias("s"), F.count("*").alias("n"))
    scale = row.n / row.s if row and row.s else 1.0
    return g.with_measure(state.select("id", (F.col("r") * scale).alias("pagerank")), {"pagerank": 0.0})


def personalized_page_rank(g: Graph, landmarks: Sequence, max_iter: int = 20, reset_probability: float = 0.15, weight: str | None = None) -> DataFrame:
    """Vertices with ``reference`` and ``pagerank``, one row per landmark; a rank is 0 where the landmark sends none.

    Per landmark: rank 1 at the landmark at first, which alone is reset to; finally scaled to sum to 1. Landmarks are all
    strings or all integers, and their number is the number of walks run at once."""
    _check_landmarks(landmarks)
    e = g.weighted(weight).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("out"))
    e = cut(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")))
    start = cut(g.ids.where(F.col("id").isin(list(dict.fromkeys(landmarks)))).select("id", F.col("id").alias("reference")))
    loop, state = Loop(), start.withColumn("r", F.lit(1.0))
    for _ in range(max_iter):
        into = state.withColumnRenamed("id", "src").join(e, "src").select(F.col("dst").alias("id"), "reference", ((1 - reset_probability) * F.col("r") * F.col("p")).alias("r"))
        state, _row = loop.keep(into.unionAll(start.withColumn("r", F.lit(reset_probability))).groupBy("id", "reference").agg(F.sum("r").alias("r")))
    total = state.groupBy("reference").agg(F.sum("r").alias("s"))
    ranks = state.join(total, "reference").select("id", "reference", (F.col("r") / F.col("s")).alias("pagerank"))
    all_ = g.vertices.drop("reference", "pagerank").crossJoin(F.broadcast(start.select("reference")))  # the landmarks given, one row each
    return all_.join(ranks, ["id", "reference"], "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
