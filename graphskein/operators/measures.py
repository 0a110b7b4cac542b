"""Measures of edges, vertices and whole graphs that look one or two hops far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.operators.neighbours import degrees, neighbour_counts, neighbour_pairs, shared_neighbours


def edge_measure(g: Graph, measure: Callable[[DataFrame, DataFrame], DataFrame], default: object, undirected: bool = False) -> DataFrame:
    """The edges with a ``measure`` of the neighbour sets of both ends; one row per input edge.

    ``measure(pairs, near)`` gets the distinct pairs ``a, b`` of the edges and the neighbour pairs ``v, w``, and gives
    ``src, dst, measure``, where a pair without row has ``default``."""
    near = neighbour_pairs(g, undirected)
    pairs = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    found = measure(pairs, near)
    kept = g.edges.drop("measure")
    return kept.join(found, ["src", "dst"], "left").withColumn("measure", F.coalesce("measure", F.lit(default))).select(*kept.columns, "measure")


def common_neighbors(g: Graph, undirected: bool = False) -> DataFrame:
    """Edges with ``measure``: the number of common neighbours of both ends (int)."""

    def count(pairs: DataFrame, near: DataFrame) -> DataFrame:
        return shared_neighbours(pairs, near).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").cast("int").alias("measure"))

    return edge_measure(g, count, 0, undirected)


def adamic_adar(g: Graph, undirected: bool = False) -> DataFrame:
    """Edges with ``measure``: the sum over common neighbours w of 1 / ln of the number of w's neighbours (double).

    A w with one neighbour makes the sum infinite, one with none adds nothing."""

    def total(pairs: DataFrame, near: DataFrame) -> DataFrame:
        k = neighbour_counts(near).select(F.col("v").alias("w"), "k")
        term = F.when(F.col("k").isNull(), 0.0).when(F.col("k") == 1, float("inf")).otherwise(1.0 / F.log(F.col("k").cast("double")))
        return shared_neighbours(pairs, near).join(k, "w", "left").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum(term).alias("measure"))

    return edge_measure(g, total, 0.0, undirected)


def _per_edge_pair(g: Graph, undirected: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct edges with their number (``a, b, m``), the number of common neighbours (``a, b, c``), set sizes (``v, k``)."""
    near = neighbour_pairs(g, undirected)
    pairs = g.directed(undirected).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count("*").alias("m"))
    return pairs, shared_neighbours(pairs.select("a", "b"), near).groupBy("a", "b").agg(F.count("*").alias("c")), neighbour_counts(near)


def clustering(g: Graph, undirected: bool = False) -> DataFrame:
    """Vertices with ``measure``: over out-edges (v, u), common neighbours of v and u, divided by k (k - 1) for k neighbours of v.

    Parallel edges repeat in the sum only; 0 for k of at most 1."""
    pairs, common, k = _per_edge_pair(g, undirected)
    top = pairs.join(common, ["a", "b"]).groupBy(F.col("a").alias("v")).agg(F.sum(F.col("m") * F.col("c")).alias("s"))
    value = F.when(F.col("k") > 1, F.col("s") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return g.with_measure(top.join(k, "v").select(F.col("v").alias("id"), value.alias("measure")), {"measure": 0.0})


def embeddedness(g: Graph, undirected: bool = False) -> DataFrame:
    """Vertices with ``measure``: over out-edges (v, u), the Jaccard index of both neighbour sets, divided by the number of neighbours of v."""
    pairs, common, k = _per_edge_pair(g, undirected)
    each = pairs.join(common, ["a", "b"]).join(k.select(F.col("v").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("v").alias("b"), F.col("k").alias("kb")), "b")
    total = each.groupBy("a").agg((F.sum(F.col("m") * F.col("c") / (F.col("ka") + F.col("kb") - F.col("c"))) / F.first("ka")).alias("measure"))
    return g.with_measure(total.select(F.col("a").alias("id"), "measure"), {"measure": 0.0})


def neighborhood(g: Graph, undirected: bool = False) -> DataFrame:
    """Vertices with ``measure``: the mean out-degree of u over out-edges (v, u), counted as often as they stand there."""
    e = g.directed(undirected).select("src", "dst")
    out = e.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("k"))
    mean = e.join(out, "dst", "left").groupBy(F.col("src").alias("id")).agg(F.avg(F.coalesce("k", F.lit(0))).alias("measure"))
    return g.with_measure(mean, {"measure": 0.0})


def degree(g: Graph, keep_all: bool = False) -> DataFrame:
    """``id, inDegree, outDegree`` (int) of the vertices that have both in- and out-edges; of all with ``keep_all``."""
    both = degrees(g).select("id", F.col("inDegree").cast("int").alias("inDegree"), F.col("outDegree").cast("int").alias("outDegree"))
    return both if keep_all else both.where("inDegree > 0 and outDegree > 0")


def freeman(g: Graph) -> float:
    """Freeman's degree centralisation: the sum of (greatest degree - degree) over vertices of positive degree, divided by
    (n - 1)(n - 2). 0.0 without edges or for n of at most 2."""
    return float(freeman_table(g).first()[0])


def freeman_table(g: Graph) -> DataFrame:
    """:func:`freeman` as a table of one row and column ``measure``."""
    ends = g.edges.select(F.col("src").alias("id")).unionAll(g.edges.select("dst")).groupBy("id").agg(F.count("*").alias("d"))
    n = g.ids.agg(F.count("*").alias("n"))  # a single row
    total = ends.agg(F.max("d").alias("top"), F.sum("d").alias("s"), F.count("*").alias("k")).crossJoin(n)
    value = (F.col("k") * F.col("top") - F.col("s")) / ((F.col("n") - 1.0) * (F.col("n") - 2))
    return total.select(F.when((F.col("n") > 2) & (F.col("k") > 0), value).otherwise(0.0).alias("measure"))


def modularity(g: Graph, community: str | None = None) -> float:
    """Modularity of the communities in the vertex column ``community``; 0.0 if it is None (one community) or there are no edges.

    With f twice the edges within a community, s the ends of crossing edges in it and m edges: the sum over communities
    of f / 2m - ((f + s) / 2m)^2."""
    return 0.0 if community is None else float(modularity_table(g, community).first()[0] or 0.0)


def modularity_table(g: Graph, community: str) -> DataFrame:
    """:func:`modularity` as a table of one row and column ``measure`` (null without edges)."""
    c = g.vertices.select("id", F.col(community).alias("c"))
    e = g.edges.select("src", "dst").join(c.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(c.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
    counted = e.groupBy("cs", "cd").agg(F.count("*").alias("n"))
    each = F.explode(F.array(F.struct(F.col("cs").alias("c")), F.struct(F.col("cd").alias("c"))))
    ends = counted.select(each.alias("x"), "n", (F.col("cs") == F.col("cd")).alias("inside")).groupBy("x.c").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("f"), F.sum("n").alias("all"))
    m2 = counted.agg((2.0 * F.sum("n")).alias("m2"))  # a single row
    return ends.crossJoin(F.broadcast(m2)).agg(F.sum(F.col("f") / F.col("m2") - F.pow(F.col("all") / F.col("m2"), 2)).alias("measure"))


def normalise_betweenness(n: int, directed: bool) -> float:
    """The divisor of betweenness sums: (n - 1)(n - 2), or half of it for undirected graphs."""
    return (n - 1.0) * (n - 2) / (1 if directed else 2)
