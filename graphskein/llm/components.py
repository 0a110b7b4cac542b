"""Groups of records linked by pairwise matches: connected components by low-diameter decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphskein.plans.heavy import LEAST_ROWS, all_salts, hot_keys, look_up, salted
from graphskein.plans.scratch import counted, cut, drop


def _start_time(v: Column, level: int, beta: float, last: int, seed: int) -> Column:
    """``last`` minus an exponential shift of rate ``beta``, rounded down, within 0..``last``. The same on every run."""
    u = (F.shiftrightunsigned(F.xxhash64(v, F.lit(seed + level)), 11).cast("double") + 1.0) / float(2**53 + 1)
    shift = F.floor(-F.log(u) / beta)
    return F.greatest(F.lit(0), F.lit(last) - shift).cast("int")


def connected_groups(
    pairs: DataFrame, left: str = "s_vertex", right: str = "d_vertex", *, beta: float = 0.6, rounds: int = 4, max_levels: int = 60, seed: int = 7,
    share: float = 0.001, least: int = LEAST_ROWS, salts: int = 32,
) -> DataFrame:
    """``vertex, component`` for every non-null value of ``left`` and ``right``; ``component`` is the smallest vertex of the group.

    A row with both ends links them; a row with one null end links nothing, but its other end is a group. Repeated,
    reversed and reflexive pairs change nothing; further columns are ignored; an empty table gives no rows.

    Each level grows clusters from start times shifted by exponential draws (a vertex that no cluster has reached
    when its time comes starts its own; a vertex reached by several joins the smallest centre) for ``rounds`` rounds in
    one plan: a round joins the state to the links, each vertex being linked to itself too, so that the state is read once,
    and reduces the offers to one per vertex, combined before the shuffle. Clusters contract to super-vertices named by
    their centres, and the next level takes the links between clusters, without repetitions. Levels end when no
    link is left; the assignments are then composed from the first to the last and named by the smallest member.
    A vertex or cluster with at least ``share`` of the rows (and ``least`` rows) is spread over ``salts`` tasks in every join.
    """
    ends = pairs.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
    named = ends.select(F.explode(F.array("a", "b")).alias("a")).where("a is not null")
    near, seen = _near(ends.where("a <> b"), named)
    levels: list[tuple[DataFrame, int]] = []
    while seen["links"]:
        if len(levels) == max_levels:
            raise RuntimeError(f"links are left after {max_levels} levels")
        rows = seen["links"]
        hot = hot_keys(near, "a", rows, share, least) if seen["top"] >= max(least, share * rows) else []
        own = near.withColumn("salt", F.when(F.col("a") == F.col("b"), 0).otherwise(salted(F.col("a"), hot, F.col("b"), salts)))
        state = _clusters(near, own, hot, salts, len(levels), beta, rounds, seed)
        clusters, size = counted(state.select("v", "c"), n=F.count("*"))
        levels.append((clusters, size["n"]))
        sides = own.where("a <> b").join(_spread(clusters, hot, salts), ["a", "salt"])
        first = F.col("a") < F.col("b")
        links = sides.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max(F.when(first, F.col("c"))).alias("a"), F.max(F.when(~first, F.col("c"))).alias("b"))
        following, seen = _near(links.where("a <> b").select("a", "b"), None)
        drop(near)
        near = following
    if not levels:
        return near.select(F.col("a").alias("vertex"), F.col("a").alias("component"))
    drop(near)
    mapping, n = levels[0][0].withColumnRenamed("c", "root"), levels[0][1]
    for clusters, _ in levels[1:]:
        up = clusters.select(F.col("v").alias("root"), "c")
        mapping = look_up(mapping, up, "root", "v", hot_keys(mapping, "root", n, share, least), salts, "left").select("v", F.coalesce("c", "root").alias("root"))
    mapping = cut(mapping)
    drop(*(clusters for clusters, _ in levels))
    lowest = mapping.groupBy("root").agg(F.min("v").alias("component"))
    return look_up(mapping, lowest, "root", "v", hot_keys(mapping, "root", n, share, least), salts).select(F.col("v").alias("vertex"), "component")


def _near(links: DataFrame, named: DataFrame | None) -> tuple[DataFrame, dict]:
    """Stores ``a, b``: each distinct link in both directions, and a row (v, v) of each end, or of each vertex ``named``. Also the
    number of links and the most rows of a vertex."""
    once = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = once.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.a", "l.b", F.lit(None).cast("long").alias("k"))
    own = (both if named is None else named).groupBy("a").agg(F.count("*").alias("k")).select("a", F.col("a").alias("b"), "k")
    near, seen = counted(both.unionAll(own), links=F.count(F.when(F.col("a") != F.col("b"), 1)), top=F.coalesce(F.max("k"), F.lit(0)))
    return near.select("a", "b"), seen


def _spread(state: DataFrame, hot: list, salts: int) -> DataFrame:
    return state.withColumnRenamed("v", "a").withColumn("salt", F.explode(all_salts(F.col("a"), hot, salts)))


def _clusters(near: DataFrame, links: DataFrame, hot: list, salts: int, level: int, beta: float, rounds: int, seed: int) -> DataFrame:
    """One decomposition: ``v, c`` with c the centre of v's cluster, for every vertex of ``near``; ``links`` has its rows with their salts."""
    start = _start_time(F.col("a"), level, beta, rounds - 1, seed)
    state = near.where("a = b").select(F.col("a").alias("v"), start.alias("t")).select("v", "t", F.when(F.col("t") == 0, F.col("v")).alias("c"), F.when(F.col("t") == 0, 0).alias("at"))
    itself = F.col("a") == F.col("b")
    for now in range(1, rounds):
        offers = links.join(_spread(state, hot, salts), ["a", "salt"]).where(itself | (F.col("at") == now - 1))
        kept = lambda c: F.max(F.when(itself, F.col(c))).alias(c)
        got = offers.groupBy(F.col("b").alias("v")).agg(kept("t"), kept("c"), kept("at"), F.min(F.when(~itself, F.col("c"))).alias("from"))
        taken = F.coalesce("c", "from", F.when(F.col("t") <= now, F.col("v")))
        state = got.select("v", "t", taken.alias("c"), F.when(F.col("at").isNotNull(), F.col("at")).when(taken.isNotNull(), now).alias("at"))
    return state
