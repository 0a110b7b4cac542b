"""Betweenness by shortest paths and by current flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.operators.community import component_labels
from graphskein.operators.kernels import KERNEL_EDGES, Adjacency, dependency_sums, flow_sums
from graphskein.operators.measures import normalise_betweenness
from graphskein.plans.fixpoint import Loop
from graphskein.plans.scratch import cut


def betweenness(g: Graph, method: str = "edmonds", batch: int | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """Vertices with ``measure``: undirected shortest-path betweenness, divided by (n - 1)(n - 2) over all ordered pairs.

    Self-loops are ignored, parallel edges are different paths. 0.0 for n of at most 2. 'edmonds' and 'hua' name two
    ways to the same measure and give the same. Up to ``kernel_edges`` distinct edges are broadcast and searched source by
    source. Beyond, or with 0, all sources advance together in joins, or in ``batch`` groups one after the other (less state
    at a time, the same result)."""
    if method not in ("edmonds", "hua"):
        raise ValueError(f"unknown method: {method}")
    e = cut(g.directed(True).where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("m")))
    ids = cut(g.ids)
    n = ids.count()
    if n <= 2:
        return g.with_measure(ids.select("id", F.lit(0.0).alias("measure")), {"measure": 0.0})
    total = None
    if adjacency := Adjacency.of(e, kernel_edges):
        total = dependency_sums(ids.join(e.select(F.col("src").alias("id")), "id", "left_semi"), adjacency)
    for i in range(batch or 1) if total is None else ():
        sources = ids.where(F.pmod(F.xxhash64("id"), F.lit(batch)) == i) if batch and batch > 1 else ids
        part = cut(_dependencies(e, sources))
        total = part if total is None else total.unionAll(part)
    value = F.sum("delta") / 2 / normalise_betweenness(n, directed=False)
    return g.with_measure(total.groupBy("id").agg(value.alias("measure")), {"measure": 0.0})


def _dependencies(e: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, delta``: the sum over sources of each vertex's dependency (Brandes)."""
    layers = [cut(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma")))]
    while True:
        reached = layers[-1].join(e, layers[-1].v == e.src).groupBy("s", F.col("dst").alias("v")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        # the new layer's neighbours lie in the last two layers or beyond
        near = layers[-1].select("s", "v") if len(layers) == 1 else layers[-1].select("s", "v").unionAll(layers[-2].select("s", "v"))
        layer = cut(reached.join(near, ["s", "v"], "left_anti"))
        if not layer.limit(1).count():
            break
        layers.append(layer)
    sums, delta = [], None
    for depth in range(len(layers) - 1, 0, -1):
        layer = layers[depth].withColumn("d", F.lit(0.0)) if delta is None else layers[depth].join(delta, ["s", "v"], "left").withColumn("d", F.coalesce("delta", F.lit(0.0)))
        sums.append(layer.groupBy(F.col("v").alias("id")).agg(F.sum("d").alias("delta")))
        share = layer.select("s", F.col("v").alias("src"), ((1 + F.col("d")) / F.col("sigma")).alias("x")).join(e, "src").select("s", F.col("dst").alias("v"), (F.col("x") * F.col("m")).alias("x"))
        back = share.join(layers[depth - 1], ["s", "v"]).groupBy("s", "v").agg((F.sum("x") * F.first("sigma")).alias("delta"))
        delta = cut(back)
    if not sums:
        return layers[0].select(F.col("v").alias("id"), F.lit(0.0).alias("delta")).distinct()
    out = sums[0]
    for x in sums[1:]:
        out = out.unionAll(x)
    return out.groupBy("id").agg(F.sum("delta").alias("delta"))


def current_flow_betweenness(g: Graph, flows: int = 10, eps: float = 1e-3, seed: int = 7, max_rounds: int = 500, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """Vertices with ``measure``: randomised current-flow betweenness.

    Every vertex with neighbours sends ``flows`` unit currents to the vertices that follow it in a random order of its component
    (``seed``), round and round if those are fewer; one met repeatedly counts as often. So each pair is as likely as any other, and
    all vertices are ends of equally many. The potential p of each current, at first supply / degree / 2, is relaxed,
    p'(v) = (sum of p over incident edges + supply) / degree with a supply of 1 at its source, -1 at its target and 0 elsewhere,
    until no potential of any current changes by ``eps`` or more; more than ``max_rounds`` rounds are an error. The measure is the
    mean, over the currents that reach v and neither start nor end in it, of the sum over incident edges of
    \\|p(neighbour) - p(v)\\| / 2. Isolated vertices have 0. From the potentials at first the rounds also settle where
    all edges lie between two sides. Up to ``kernel_edges`` distinct edges are broadcast; beyond, or with 0, all currents
    advance together in joins (the same result)."""
    e = cut(g.directed(True).where("src <> dst").select("src", "dst"))
    deg = cut(e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg")))
    if deg.count() < 2:
        return g.with_measure(g.ids.select("id", F.lit(0.0).alias("measure")), {"measure": 0.0})
    runs = cut(currents(deg, e, flows, seed))
    if adjacency := Adjacency.of(e.groupBy("src", "dst").agg(F.count("*").cast("double").alias("m")), kernel_edges):
        sums = flow_sums(runs, adjacency, eps, max_rounds)
        return g.with_measure(sums.groupBy("id").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").select("id", (F.col("total") / F.col("n")).alias("measure")), {"measure": 0.0})
    loop = Loop(every=1)
    supply = F.when(F.col("v") == F.col("s"), 1.0).when(F.col("v") == F.col("t"), -1.0).otherwise(0.0)
    ends = cut(runs.select("s", "t", F.explode(F.array("s", "t")).alias("v")).join(deg, "v").select("s", "t", "v", (supply / F.col("deg") / 2).alias("p")))
    state, row = loop.keep(ends.withColumn("change", F.lit(1.0)))
    for _ in range(max_rounds):
        sent = state.join(e, state.v == e.src).groupBy("s", "t", F.col("dst").alias("v")).agg(F.sum("p").alias("p"))
        got = sent.unionAll(ends.withColumn("p", F.lit(0.0))).groupBy("s", "t", "v").agg(F.sum("p").alias("p")).join(deg, "v")
        new = got.select("s", "t", "v", ((F.col("p") + supply) / F.col("deg")).alias("q")).join(state.select("s", "t", "v", F.col("p").alias("old")), ["s", "t", "v"], "left")
        state, row = loop.keep(new.select("s", "t", "v", F.col("q").alias("p"), F.abs(F.col("q") - F.coalesce("old", F.lit(0.0))).alias("change")), F.max("change").alias("c"))
        if row.c is None or row.c < eps:
            break
    else:
        raise RuntimeError(f"potentials still change after {max_rounds} rounds")
    there = state.select("s", "t", "v", "p")
    near = there.select("s", "t", F.col("v").alias("dst"), F.col("p").alias("pn"))
    each = there.where("v <> s and v <> t").join(e, F.col("v") == e.src).join(near, ["s", "t", "dst"], "left")
    per_flow = each.groupBy("s", "t", "v").agg((F.sum(F.abs(F.coalesce("pn", F.lit(0.0)) - F.col("p"))) / 2).alias("x")).join(runs, ["s", "t"])
    return g.with_measure(per_flow.groupBy(F.col("v").alias("id")).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("measure")), {"measure": 0.0})


def currents(deg: DataFrame, e: DataFrame, flows: int, seed: int) -> DataFrame:
    """``s, t, n, at``: for each ``v`` of ``deg`` as source the next ``flows`` vertices, counted by target, in a random order of its
    component over ``e``, where ``s`` has place ``at``; the first follows the last."""
    part = component_labels(deg.select(F.col("v").alias("id")), e).select(F.col("id").alias("v"), "component", F.xxhash64("id", F.lit(seed)).alias("h"))
    # ranks in the order of hashes: within a range of hashes, after the sizes of the ranges before
    parted = part.withColumn("b", F.shiftright("h", 52))
    sizes = parted.groupBy("component", "b").agg(F.count("*").alias("size"))
    by = Window.partitionBy("component")
    before = sizes.select("component", "b", (F.sum("size").over(by.orderBy("b")) - F.col("size")).alias("before"), F.sum("size").over(by).alias("m"))
    within = parted.withColumn("i", F.row_number().over(Window.partitionBy("component", "b").orderBy("h", "v")) - 1)
    ranked = cut(within.join(before, ["component", "b"]).select("v", "component", "m", (F.col("before") + F.col("i")).alias("r")))
    wanted = ranked.select("component", "m", "r", F.col("v").alias("s"), F.explode(F.sequence(F.lit(1), F.lit(flows))).alias("k"))
    step = 1 + F.pmod(F.col("k") - 1, F.col("m") - 1)
    picks = wanted.select("component", "s", F.col("r").alias("at"), F.pmod(F.col("r") + step, F.col("m")).alias("r"))
    return picks.join(ranked.select("component", "r", F.col("v").alias("t")), ["component", "r"]).groupBy("s", "t").agg(F.count("*").alias("n"), F.first("at").alias("at"))
