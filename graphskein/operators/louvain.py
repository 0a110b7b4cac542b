"""Synchronous Louvain communities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.plans.scratch import cut, drop


@dataclass
class Level:
    """``vertices``: v, internal, k (weight of incident edges); ``edges``: src, dst, w, merged by direction."""

    vertices: DataFrame
    edges: DataFrame


def first_level(g: Graph, weight: str | None = None) -> Level:
    """Integer weights (1 without ``weight``); a self-loop counts twice at its vertex."""
    w = (F.col(weight) if weight else F.lit(1)).cast("long")
    edges = cut(g.edges.select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    ends = edges.select(F.col("src").alias("v"), "w").unionAll(edges.select("dst", "w")).groupBy("v").agg(F.sum("w").alias("k"))
    zero = F.lit(0).cast("long")
    return Level(cut(g.ids.withColumnRenamed("id", "v").join(ends, "v", "left").select("v", zero.alias("internal"), F.coalesce("k", zero).alias("k"))), edges)


def move_vertices(level: Level, min_progress: int = 1, progress_counter: int = 1, max_rounds: int = 100_000) -> tuple[DataFrame, float, int]:
    """One level: ``v, c``, its modularity and the number of rounds.

    In a round every vertex looks at the communities c of its neighbours: gain = k_in - k_i * sigma(c) / M, where for its own
    community k_in grows by its internal weight and sigma shrinks by k_i (0 if nothing is left then). It moves to the
    greatest positive gain (of equal ones the largest id), in odd rounds of the count only to lower ids, in even ones
    only to higher. Gains are compared as exact integers. The level ends after a pair of rounds without a move, or after more than
    ``progress_counter`` pairs that moved no fewer than the pair before less ``min_progress``."""
    both = cut(level.edges.unionAll(level.edges.select("dst", "src", "w")).toDF("a", "b", "w").groupBy("a", "b").agg(F.sum("w").alias("w")))
    m = level.vertices.agg(F.sum(F.col("internal") + F.col("k"))).first()[0] or 0
    state = cut(level.vertices.select("v", F.col("v").alias("c"), "internal", (F.col("internal") + F.col("k")).alias("ki")))
    if not m:
        return state.select("v", "c"), 0.0, 0
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    toward, updated, last, stop, count = False, 0, 0, 0, 0
    while True:
        count += 1
        toward = not toward
        near = _near(both, state)
        own = F.col("cc") == F.col("c")
        kin = (F.col("kin") + F.when(own, F.col("internal")).otherwise(0)).cast("decimal(19,0)")
        rest = F.when(own, F.col("sc") - F.col("ki")).otherwise(F.col("sc"))
        gain = F.when(own & (rest == 0), F.lit(0).cast("decimal(38,0)")).otherwise((kin * F.lit(m).cast("decimal(19,0)") - exact("ki") * rest.cast("decimal(19,0)")).cast("decimal(38,0)"))
        best = near.join(state, "v").select("v", F.struct(gain.alias("gain"), F.col("cc").alias("cc")).alias("s")).where("s.gain > 0").groupBy("v").agg(F.max("s").alias("s"))
        goes = (F.col("s.cc") < F.col("c")) if toward else (F.col("s.cc") > F.col("c"))
        moved = F.coalesce(goes, F.lit(False))
        new = cut(state.join(best, "v", "left").select("v", F.when(moved, F.col("s.cc")).otherwise(F.col("c")).alias("c"), "internal", "ki", moved.alias("moved")))
        n = new.where("moved").count()
        drop(state)
        state = new.drop("moved")
        state._cut_path = new._cut_path
        updated = n if toward else updated + n
        if not toward:
            stop += updated >= last - min_progress
            last = updated
        if not (stop <= progress_counter and (toward or (updated > 0 and count < max_rounds))):
            break
    inside = _near(both, state).join(state, "v").groupBy("v").agg(F.sum(F.when(F.col("cc") == F.col("c"), F.col("kin")).otherwise(0)).alias("w"), F.first("internal").alias("internal"), F.first("ki").alias("ki"), F.first("c").alias("c"))
    total = state.groupBy("c").agg(F.sum("ki").alias("sigma"))
    inside = inside.join(total, "c")
    q = inside.agg(F.sum(F.greatest(F.lit(0.0), (F.col("internal") + F.col("w")) / F.lit(float(m)) - F.col("sigma").cast("double") * F.col("ki") / F.lit(float(m) ** 2)))).first()[0]
    return state.select("v", "c"), float(q or 0.0), count


def _near(both: DataFrame, state: DataFrame) -> DataFrame:
    """``v, cc, sc, kin``: the communities of a vertex's neighbours with their total weight, and the weight of the edges to them."""
    at = state.select(F.col("v").alias("a"), F.col("c").alias("cc"))
    near = both.join(at, "a").groupBy(F.col("b").alias("v"), "cc").agg(F.sum("w").alias("kin"))
    return near.join(state.groupBy(F.col("c").alias("cc")).agg(F.sum("ki").alias("sc")), "cc")


def compress(level: Level, membership: DataFrame) -> Level:
    """Communities become vertices: internal weight adds up, with twice the weight of inner edges; edges between are merged."""
    side = lambda end, name: membership.select(F.col("v").alias(end), F.col("c").alias(name))
    e = level.edges.join(side("src", "cs"), "src").join(side("dst", "cd"), "dst").groupBy("cs", "cd").agg(F.sum("w").alias("w"))
    e = cut(e)
    inner = e.where("cs = cd").select(F.col("cs").alias("v"), (2 * F.col("w")).alias("internal"))
    own = level.vertices.join(membership, "v").select(F.col("c").alias("v"), "internal").unionAll(inner).groupBy("v").agg(F.sum("internal").alias("internal"))
    between = cut(e.where("cs <> cd").groupBy(F.least("cs", "cd").alias("src"), F.greatest("cs", "cd").alias("dst")).agg(F.sum("w").alias("w")))
    ends = between.select(F.col("src").alias("v"), "w").unionAll(between.select("dst", "w")).groupBy("v").agg(F.sum("w").alias("k"))
    vertices = cut(own.join(ends, "v", "left").select("v", "internal", F.coalesce("k", F.lit(0).cast("long")).alias("k")))
    drop(e)
    return Level(vertices, between)


def louvain_membership(g: Graph, min_progress: int = 1, progress_counter: int = 1, min_gain: float = 0.001, weight: str | None = None) -> tuple[DataFrame, float]:
    """``id, community`` of all vertices, composed over all levels, and the last modularity that improved by more than ``min_gain``."""
    level, best = first_level(g, weight), -1.0
    mapping = cut(level.vertices.select(F.col("v").alias("id"), F.col("v").alias("community")))
    while True:
        membership, q, rounds = move_vertices(level, min_progress, progress_counter)
        if not q > best + min_gain:
            return mapping, max(best, 0.0) if best >= 0 else q
        best = q
        new = cut(mapping.join(membership.select(F.col("v").alias("community"), "c"), "community").select("id", F.col("c").alias("community")))
        drop(mapping)
        mapping = new
        level = compress(level, membership)


def louvain(g: Graph, min_progress: int = 1, progress_counter: int = 1, *, reference_compat: bool = False, weight: str | None = None) -> DataFrame:
    """Vertices with ``community``. ``reference_compat`` keeps only vertices whose id is the id of a community."""
    mapping, _ = louvain_membership(g, min_progress, progress_counter, weight=weight)
    out = g.with_measure(mapping, {})
    return out.join(mapping.select(F.col("community").alias("id")).distinct(), "id", "left_semi") if reference_compat else out
