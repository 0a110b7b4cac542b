"""Distances and shortest paths."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphskein.graph import Graph
from graphskein.operators.kernels import KERNEL_EDGES, Adjacency, distance_sums, distances, path_lists
from graphskein.plans.scratch import cut, drop


# vertex predicates: conditions on an id column
def all_vertices(v: Column) -> Column:
    return F.lit(True)


def by_id(wanted: object) -> Callable[[Column], Column]:
    return lambda v: v == F.lit(wanted)


def by_ids(wanted: Sequence) -> Callable[[Column], Column]:
    return lambda v: v.isin(list(wanted))


def any_in_component(inner: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """For an array of ids: any of them meets ``inner``."""
    return lambda members: F.exists(members, inner)


def bfs(g: Graph, sources: DataFrame, undirected: bool = False, max_depth: int | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """``source, id, distance`` (int): hops from each id of ``sources(id)`` along out-edges, 0 for itself.

    Up to ``kernel_edges`` distinct edges are broadcast and searched source by source; more, or with 0 any, are joined
    to the frontiers of all sources, round by round."""
    e = cut(g.directed(undirected).select("src", "dst").where("src <> dst").distinct())
    if adjacency := Adjacency.of(e.withColumn("m", F.lit(1.0)), kernel_edges):
        drop(e)
        return distances(sources.select("id").where("id is not null").distinct(), adjacency, max_depth)
    front = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")).distinct())
    seen, depth = [front], 0
    while front.limit(1).count() and (max_depth is None or depth < max_depth):
        depth += 1
        reached = front.join(e, front.id == e.src).select("source", F.col("dst").alias("id"), F.lit(depth).alias("distance")).distinct()
        # a vertex reached now is either new or was seen before, at any smaller depth
        front = cut(reached.join(_union(seen).select("source", "id"), ["source", "id"], "left_anti"))
        seen.append(front)
        if len(seen) > 8:
            seen = [cut(_union(seen))]
    drop(e)
    return _union(seen)


def _union(dfs: Sequence[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionAll(df)
    return out


def path_lengths(
    g: Graph, targets: Callable[[Column], Column] = all_vertices, *, undirected: bool = False, weight: str | None = None, with_paths: bool = False,
    batch: int | None = None, max_rounds: int = 10_000, kernel_edges: int = KERNEL_EDGES,
) -> DataFrame:
    """``id, target, distance`` (double): the least weight of a path from each vertex along out-edges to each target it
    reaches; 0.0 for itself. Without ``weight`` every edge weighs 1; weights must not be negative.

    ``with_paths`` adds ``paths``: all minimal paths, each the target first and the first hop last, without the start.
    Hops, with or without paths, up to ``kernel_edges`` edges, are found as in :func:`bfs`, target by target along edges
    backwards. Beyond, or with weights, ``batch`` works on so many groups of targets, one after the other: less state at a
    time, the same result.
    """
    e = cut(g.directed(undirected, weight).where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")))
    if not weight:
        turned = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        wanted = g.ids.where(targets(F.col("id")))
        adjacency = Adjacency.of(turned.withColumn("m", F.lit(1.0)), kernel_edges)
        if adjacency and with_paths:
            drop(e)
            return path_lists(wanted, adjacency)
        if adjacency or not with_paths and not (batch and batch > 1):
            found = distances(wanted, adjacency) if adjacency else bfs(Graph(g.vertices, turned), wanted, kernel_edges=0)
            drop(e)
            return found.select("id", F.col("source").alias("target"), F.col("distance").cast("double").alias("distance"))
    ids = g.ids.where(targets(F.col("id")))
    groups = [ids.where(F.pmod(F.xxhash64("id"), F.lit(batch)) == i) for i in range(batch)] if batch and batch > 1 else [ids]
    out = _union([_relax(e, group, with_paths, max_rounds) for group in groups])
    drop(e)
    return out


def _relax(e: DataFrame, targets: DataFrame, with_paths: bool, max_rounds: int) -> DataFrame:
    paths = [F.array(F.expr("array()").cast(T.ArrayType(targets.schema["id"].dataType))).alias("paths")] if with_paths else []
    best = cut(targets.select("id", F.col("id").alias("target"), F.lit(0.0).alias("distance"), *paths))
    front = best
    for _ in range(max_rounds):
        if not front.limit(1).count():
            return best
        # along edges backwards: src reaches what dst reaches
        step = front.select(F.col("id").alias("dst"), "target", F.col("distance").alias("d"), *(["paths"] if with_paths else [])).join(e, "dst")
        offers = step.select(F.col("src").alias("id"), "target", (F.col("d") + F.col("w")).alias("distance"), *([F.transform("paths", lambda p: F.array_append(p, F.col("dst"))).alias("paths")] if with_paths else []))
        if not with_paths:
            offers = offers.groupBy("id", "target").agg(F.min("distance").alias("distance"))
            known = best.withColumnRenamed("distance", "old")
            better = offers.join(known, ["id", "target"], "left").where("old is null or distance < old").select("id", "target", "distance")
            new_front = cut(better)
            merged = best.join(new_front.select("id", "target"), ["id", "target"], "left_anti").unionAll(new_front)
        else:
            least = offers.groupBy("id", "target").agg(F.min("distance").alias("least"))
            offered = offers.join(least, ["id", "target"]).where("distance = least").groupBy("id", "target").agg(F.first("least").alias("distance"), F.array_distinct(F.flatten(F.collect_list("paths"))).alias("paths"))
            known = best.select("id", "target", F.col("distance").alias("old"), F.col("paths").alias("had"))
            both = offered.join(known, ["id", "target"], "left").where("old is null or distance <= old")
            grown = F.when(F.col("distance") == F.col("old"), F.array_union("had", "paths")).otherwise(F.col("paths"))
            grown = F.filter(grown, lambda p: ~F.array_contains(p, F.col("id")) | (F.col("id") == F.col("target")))
            new = both.select("id", "target", "distance", grown.alias("paths"), F.coalesce((F.col("distance") == F.col("old")) & (F.size(grown) <= F.size("had")), F.lit(False)).alias("same"))
            new_front = cut(new.where("not same").drop("same"))
            merged = best.join(new_front.select("id", "target"), ["id", "target"], "left_anti").unionAll(new_front)
        now = cut(merged)
        if best is not front:
            drop(front)
        drop(best)
        best, front = now, new_front
    raise RuntimeError(f"distances still change after {max_rounds} rounds")


def distances_to(g: Graph, target: object, undirected: bool = False, weight: str | None = None) -> DataFrame:
    """``id, distance`` of every vertex to one target; null if it does not reach it."""
    d = path_lengths(g, by_id(target), undirected=undirected, weight=weight)
    return g.ids.join(d.select("id", "distance"), "id", "left")


def shortest_paths(g: Graph, landmarks: Sequence) -> DataFrame:
    """Vertices with ``distance`` (int, hops along out-edges) and ``reference``, one row per landmark that they reach.

    Landmarks are all strings or all integers; others are refused. Vertices that reach none have no row."""
    _check_landmarks(landmarks)
    back = Graph(g.vertices, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    wanted = g.ids.where(F.col("id").isin(list(landmarks)))
    found = bfs(back, wanted).select("id", "distance", F.col("source").alias("reference"))
    return g.vertices.drop("distance", "reference").join(found, "id")


def _check_landmarks(landmarks: Sequence) -> None:
    if not landmarks:
        raise ValueError("no landmarks")
    if isinstance(landmarks[0], bool) or not isinstance(landmarks[0], (str, int)) or any(type(x) is not type(landmarks[0]) for x in landmarks):
        raise TypeError("landmarks must be all strings or all integers")


def closeness(g: Graph, *, kind: str = "standard", normalize: bool = False, undirected: bool = False, batch: int | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """Vertices with ``measure`` from the hops d to every other vertex reached along out-edges; 0 if none is.

    'standard': 1 / sum of d, normalised times (n - 1); 'harmonic': sum of 1 / d, normalised by (n - 1). ``kernel_edges`` as in
    :func:`bfs`; ``batch`` is for larger graphs only, and works on so many groups of sources one after the other."""
    if kind not in ("standard", "harmonic"):
        raise ValueError(f"unknown kind: {kind}")
    ids = g.ids
    e = cut(g.directed(undirected).select("src", "dst").where("src <> dst").distinct())
    if adjacency := Adjacency.of(e.withColumn("m", F.lit(1.0)), kernel_edges):
        value = 1.0 / F.col("total") if kind == "standard" else F.col("inverse")
        measured = distance_sums(ids, adjacency).where("not isnan(total)").select("id", value.alias("measure"))
    else:
        groups = [ids.where(F.pmod(F.xxhash64("id"), F.lit(batch)) == i) for i in range(batch)] if batch and batch > 1 else [ids]
        parts = []
        for group in groups:
            d = bfs(g, group, undirected, kernel_edges=0).where("distance > 0")
            value = 1.0 / F.sum("distance") if kind == "standard" else F.sum(1.0 / F.col("distance"))
            parts.append(cut(d.groupBy(F.col("source").alias("id")).agg(value.alias("measure"))))
        measured = _union(parts)
    drop(e)
    out = g.with_measure(measured, {"measure": 0.0})
    if normalize:
        others = g.ids.count() - 1.0
        out = out.withColumn("measure", F.col("measure") * others if kind == "standard" else F.col("measure") / max(others, 1.0))
    return out


def write_distances(g: Graph, folder: str, *, undirected: bool = False, weight: str | None = None, batch: int = 1, form: str = "text", lengths: DataFrame | None = None) -> None:
    """All-pairs distances below ``folder``: ``paths`` (text lines 'id;target:distance;...', or Parquet rows ``id, target,
    distance``) and ``index`` (text lines 'id;other columns' of the vertices)."""
    d = lengths if lengths is not None else path_lengths(g, undirected=undirected, weight=weight, batch=batch)
    if form == "parquet":
        d.write.mode("overwrite").parquet(f"{folder}/paths")
    else:
        cell = F.concat_ws(":", F.col("target").cast("string"), F.col("distance").cast("string"))
        lines = d.groupBy("id").agg(F.concat_ws(";", F.sort_array(F.collect_list(cell))).alias("cells"))
        lines.select(F.concat_ws(";", F.col("id").cast("string"), "cells").alias("value")).write.mode("overwrite").text(f"{folder}/paths")
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in g.vertices.columns if c != "id"]
    g.vertices.select(F.concat_ws(";", F.col("id").cast("string"), *rest).alias("value")).write.mode("overwrite").text(f"{folder}/index")
