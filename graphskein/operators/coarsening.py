"""Coarse graphs, and distances approximated on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.operators.kernels import KERNEL_EDGES, Adjacency, coarse_distances
from graphskein.operators.paths import all_vertices, path_lengths
from graphskein.plans.scratch import cut, drop


def coarse_labels(g: Graph, undirected: bool = False, max_rounds: int = 1000) -> DataFrame:
    """``id, label``: label propagation that merges vertices into groups around a member.

    Repeats until no label changes: (a) a vertex that still carries its own id, with in-neighbours (with ``undirected``
    all neighbours) that do too, takes the most frequent id among them and itself, of equally frequent ones the least;
    (b) a vertex none of whose neighbours carries its label takes its own id again."""
    e = cut(g.directed(undirected).where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    state = cut(g.ids.select("id", F.col("id").alias("now"), F.col("id").alias("b1"), F.col("id").alias("b2")))
    for _ in range(max_rounds):
        free = state.where("id = now").select("id")
        sent = e.join(free.withColumnRenamed("id", "src"), "src", "left_semi").join(free.withColumnRenamed("id", "dst"), "dst", "left_semi")
        votes = sent.select(F.col("dst").alias("id"), F.col("src").alias("l"), "w").unionAll(sent.select(F.col("dst").alias("id"), F.col("dst").alias("l"), F.lit(1.0)).distinct())
        votes = votes.groupBy("id", "l").agg(F.sum("w").alias("n"))
        top = votes.groupBy("id").agg(F.max("n").alias("n"))
        choice = votes.join(top, ["id", "n"]).groupBy("id").agg(F.min("l").alias("l"))
        got = F.col("l").isNotNull()
        a = cut(state.join(choice, "id", "left").select("id", F.when(got, F.col("l")).otherwise(F.col("now")).alias("now"), F.when(got, F.col("now")).otherwise(F.col("b1")).alias("b1"), F.when(got, F.col("b1")).otherwise(F.col("b2")).alias("b2"), (got & (F.col("l") != F.col("now"))).alias("changed")))
        labels = e.join(a.select(F.col("id").alias("src"), F.col("now").alias("l")), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k"), F.collect_set("l").alias("ls"))
        lost = F.col("k").isNotNull() & ~F.array_contains("ls", F.col("now"))
        back = F.when(F.col("now") == F.col("b2"), F.lit(False)).otherwise(F.col("id") != F.col("now"))
        b = a.join(labels, "id", "left").select("id", F.when(lost, F.col("id")).otherwise(F.col("now")).alias("now"), F.when(lost, F.col("now")).otherwise(F.col("b1")).alias("b1"), F.when(lost, F.col("b1")).otherwise(F.col("b2")).alias("b2"), F.when(lost, back).otherwise(F.coalesce("changed", F.lit(False))).alias("changed"))
        new = cut(b)
        moved = new.where("changed").limit(1).count()
        drop(state, a)
        state = new.drop("changed")
        state._cut_path = new._cut_path
        if not moved:
            return state.select("id", F.col("now").alias("label"))
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def coarsen(g: Graph, undirected: bool = False, weight: str | None = None, pick: Callable[[Column], Column] = F.min) -> Graph:
    """The graph of groups: vertices ``id, component`` (sorted members), edges ``src, dst, value`` between different groups,
    one for all parallel ones, whose value is ``pick`` of theirs."""
    labels = coarse_labels(g, undirected)
    return contract(g, labels, weight, pick)


def contract(g: Graph, labels: DataFrame, weight: str | None = None, pick: Callable[[Column], Column] = F.min) -> Graph:
    """:func:`coarsen` with given ``id, label``."""
    vertices = labels.groupBy(F.col("label").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("component"))
    side = lambda end, name: labels.select(F.col("id").alias(end), F.col("label").alias(name))
    e = g.weighted(weight).join(side("src", "s"), "src").join(side("dst", "d"), "dst").where("s <> d")
    return Graph(vertices, e.groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(pick("w").alias("value")))


def approximate_path_lengths(
    g: Graph, targets: Callable[[Column], Column] = all_vertices, *, undirected: bool = True, modifier: Callable[[Column], Column] = lambda d: 3 * d + 2,
    labels: DataFrame | None = None, batch: int | None = None, kernel_edges: int = KERNEL_EDGES,
) -> DataFrame:
    """``id, target, distance`` (double): hop distances through a coarse graph.

    Exact distances between groups pass ``modifier``; every member of a group takes them to every member of the other;
    edges give 1, pairs two edges apart 2, a target itself 0; the least of a pair holds. Members of one group more than two hops
    apart have no row unless another rule gives one. Up to ``kernel_edges`` distinct edges, and as many members of groups with
    edges, are broadcast, and all rows of a target found at once; beyond, or with 0, the rules are joined."""
    labels = cut(labels if labels is not None else coarse_labels(g, undirected))
    groups = contract(g, labels)
    wanted = cut(labels.where(targets(F.col("id"))).select(F.col("id").alias("target"), F.col("label").alias("tl")))
    e = cut(g.directed(undirected).select("src", "dst").distinct())
    links = cut(groups.directed(undirected).select("src", "dst").distinct())
    members = labels.join(links.select(F.explode(F.array("src", "dst")).alias("label")), "label", "left_semi")
    turned = lambda df: Adjacency.of(df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("m")), kernel_edges)
    if kernel_edges > 0 and members.count() <= kernel_edges and (near := turned(e)) and (coarse := turned(links)):
        found = coarse_distances(wanted, members, coarse, near)
        return found.select("id", "target", F.least(F.when(F.col("between").isNotNull(), modifier(F.col("between"))), "near").alias("distance"))
    hit = wanted.select(F.col("tl").alias("id")).distinct()
    between = _to_groups(groups, hit, undirected, batch).where("distance > 0").select(F.col("id").alias("label"), F.col("target").alias("tl"), modifier(F.col("distance")).alias("distance"))
    far = between.join(labels, "label").join(wanted, "tl").select("id", "target", "distance")
    to = wanted.select(F.col("target").alias("dst"))
    one = e.join(to, "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("target"), F.lit(1.0).alias("distance"))
    two = e.select(F.col("src").alias("id"), F.col("dst").alias("mid")).join(one.select(F.col("id").alias("mid"), "target"), "mid").select("id", "target", F.lit(2.0).alias("distance"))
    near = one.unionAll(two).where("id <> target")
    self_ = wanted.select(F.col("target").alias("id"), "target", F.lit(0.0).alias("distance"))
    return far.unionAll(near).unionAll(self_).groupBy("id", "target").agg(F.min("distance").alias("distance"))


def _to_groups(groups: Graph, hit: DataFrame, undirected: bool, batch: int | None) -> DataFrame:
    d = path_lengths(Graph(groups.vertices.select("id"), groups.edges.select("src", "dst")), undirected=undirected, batch=batch)
    return d.join(hit.withColumnRenamed("id", "target"), "target", "left_semi")
