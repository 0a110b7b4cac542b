"""Components, label propagation and structural communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.operators.neighbours import neighbour_counts, neighbour_pairs, shared_neighbours
from graphskein.plans.scratch import cut, drop


def component_labels(ids: DataFrame, links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``id, component`` of every id of ``ids(id)``: the least id linked to it directly or indirectly by ``links(src, dst)``.

    Alternates linking every larger neighbour to the least one around a vertex, and every smaller one, until
    nothing changes (large-star, small-star): the number of rounds grows with the logarithm of the number of vertices."""
    now = cut(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct())
        drop(large)
        stats = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop(now)
        now = new
        if before == (stats.n, stats.h):
            return ids.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        before = (stats.n, stats.h)
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def connected_components(g: Graph) -> DataFrame:
    """Vertices with ``component``: the least id of their weakly connected component."""
    return g.with_measure(component_labels(g.ids, g.edges.select("src", "dst")), {})


def strongly_connected_components(g: Graph, max_iter: int = 10) -> DataFrame:
    """Vertices with ``component``: the least id of their strongly connected component.

    Each of at most ``max_iter`` rounds removes vertices without in- or out-edges, colours the rest by the least id that
    reaches it, and settles what reaches its colour's root back. Vertices left after the last round keep their own id."""
    ids = cut(g.ids)
    e = cut(g.edges.select("src", "dst").where("src <> dst").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    settled = []
    for _ in range(max_iter):
        while True:  # only vertices with in- and out-edges can lie on a cycle
            inner = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            inner = cut(inner)
            kept = cut(e.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
            same = kept.count() == e.count()
            drop(e, inner)
            e = kept
            if same:
                break
        if not e.limit(1).count():
            break
        colour = cut(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("c", F.col("id")))
        while True:
            sent = colour.select(F.col("id").alias("src"), "c").join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = cut(colour.join(sent, "id", "left").select("id", F.least("c", "m").alias("c"), F.coalesce(F.col("m") < F.col("c"), F.lit(False)).alias("moved")))
            drop(colour)
            moved = new.where("moved").limit(1).count()
            colour = new
            if not moved:
                break
        side = lambda end: colour.select(F.col("id").alias(end), F.col("c").alias(f"c_{end}"))  # noqa: E731, B023
        inside = cut(e.join(side("src"), "src").join(side("dst"), "dst").where("c_src = c_dst").select("src", "dst", F.col("c_src").alias("c")))
        found = cut(colour.where("id = c").select("id", "c"))
        front = found
        while front.limit(1).count():
            back = front.withColumnRenamed("id", "dst").join(inside, ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            front = cut(back.join(found, ["id", "c"], "left_anti"))
            found = cut(found.unionAll(front))
        settled.append(found)
        rest = cut(e.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
        drop(e)
        e = rest
    labels = ids.withColumn("component", F.col("id"))
    if settled:
        all_ = settled[0]
        for s in settled[1:]:
            all_ = all_.unionAll(s)
        labels = ids.join(all_, "id", "left").select("id", F.coalesce("c", "id").alias("component"))
    return g.with_measure(labels, {})


def label_propagation(g: Graph, iterations: int) -> DataFrame:
    """Vertices with ``label``: in each round every vertex takes the most frequent label among its neighbours in both
    directions (of equally frequent ones the least), starting from ids; without neighbours it keeps its own."""
    e = cut(g.directed(True).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    state = cut(g.ids.withColumn("label", F.col("id")))
    for _ in range(iterations):
        votes = state.withColumnRenamed("id", "src").join(e, "src").groupBy(F.col("dst").alias("id"), "label").agg(F.sum("w").alias("n"))
        most = votes.groupBy("id").agg(F.max("n").alias("n"))
        best = votes.join(most, ["id", "n"]).groupBy("id").agg(F.min("label").alias("best"))
        new = cut(state.join(best, "id", "left").select("id", F.coalesce("best", "label").alias("label")))
        drop(state)
        state = new
    return g.with_measure(state, {})


def structural_similarity(g: Graph) -> DataFrame:
    """``src, dst, similarity`` of every distinct edge: common neighbours in both directions over the root of the product of both numbers of neighbours."""
    near = cut(neighbour_pairs(g, undirected=True))
    k = neighbour_counts(near)
    pairs = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    common = shared_neighbours(pairs, near).groupBy("a", "b").agg(F.count("*").alias("c"))
    sized = pairs.join(common, ["a", "b"], "left").join(k.select(F.col("v").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("v").alias("b"), F.col("k").alias("kb")), "b")
    return sized.select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.coalesce("c", F.lit(0)) / F.sqrt(F.col("ka").cast("double") * F.col("kb"))).alias("similarity"))


def pscan(g: Graph, epsilon: float = 0.05) -> DataFrame:
    """Vertices with ``label``: the least id of their component over the edges of :func:`structural_similarity` of at least ``epsilon``."""
    kept = structural_similarity(g).where(F.col("similarity") >= epsilon)
    return g.with_measure(component_labels(g.ids, kept).withColumnRenamed("component", "label"), {})


def pscan_with_components(g: Graph, required: int = 32) -> tuple[DataFrame, float]:
    """Vertices with ``label``, and the threshold used: the cut (similarity > threshold) whose number of components is at
    least ``required`` and closest to it, by bisection over the sorted distinct similarities with -1 and 2 around them until none is left between.

    Of each step only the middle value and the number of components come to the driver."""
    similar = cut(structural_similarity(g))
    values = cut(similar.select("similarity").distinct())
    ids = cut(g.ids)
    low, high, best = -1.0, 2.0, 2.0
    best_labels, best_n = ids.withColumn("component", F.col("id")), ids.count()
    tried = low
    while True:
        labels = cut(component_labels(ids, similar.where(F.col("similarity") > tried)))
        n = labels.select("component").distinct().count()
        if n >= required and n <= best_n:
            best, best_n, best_labels = tried, n, labels
        if n == required:
            break
        low, high = (tried, high) if n < required else (low, tried)
        middle = values.where((F.col("similarity") > low) & (F.col("similarity") < high)).agg(F.percentile_approx("similarity", 0.5, 100_000).alias("m")).first().m
        if middle is None or high <= low:
            break
        tried = middle
    return g.with_measure(best_labels.withColumnRenamed("component", "label"), {}), best
