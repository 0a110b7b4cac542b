"""Loops over DataFrame state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from graphskein.plans.scratch import cut, drop


class Loop:
    """Holds the state of a loop: cached after every step, and cut to the shared folder every ``every`` steps, so that a
    lost executor costs at most that many steps again. Former states are freed when no recovery can need them."""

    def __init__(self, every: int = 8):
        self.every, self.step = every, 0
        self.cuts: list[DataFrame] = []
        self.cached: list[DataFrame] = []

    def keep(self, state: DataFrame, *aggregates: Column) -> tuple[DataFrame, Row | None]:
        """The state, computed, and the aggregates over it, computed in the same pass where it is cached."""
        if self.step % self.every == 0:
            now = cut(state)
            row = now.agg(*aggregates).first() if aggregates else None
            for old in self.cached:
                old.unpersist()
            drop(*self.cuts)
            self.cached, self.cuts = [], [now]
        else:
            now = state.persist()
            row = now.agg(*(aggregates or (F.count("*"),))).first()
            for old in self.cached:
                old.unpersist()
            self.cached = [now]
        self.step += 1
        return now, row


def pregel(
    vertices: DataFrame, edges: DataFrame, prepare: dict[str, Column], to_dst: Column | None, to_src: Column | None, merge: Callable[[Column], Column], update: Callable[[Column, int], dict[str, Column]],
    *, active: Callable[[int], Column] | None = None, max_rounds: int = 20, stop_after_empty: int = 1,
) -> DataFrame:
    """Rounds of messages along edges: every vertex is updated in every round, with or without a message.

    ``prepare`` gives the state columns of ``vertices(id, ...)``. In a round, ``to_dst`` and ``to_src`` are messages of each
    edge, expressions over ``src_<state>``, ``dst_<state>`` and the edge's columns (null sends nothing); ``merge`` is
    the aggregate of a vertex's messages; ``update(message, round)`` gives its new state (the message is null if none came).
    Ends after ``max_rounds`` or ``stop_after_empty`` rounds without any message.
    """
    names = list(prepare)
    loop = Loop(every=1)
    state, _ = loop.keep(vertices.select("id", *(c.alias(n) for n, c in prepare.items())))
    empty = 0
    for now in range(1, max_rounds + 1):
        at = lambda side: state.select(F.col("id").alias(side), *(F.col(n).alias(f"{side}_{n}") for n in names))  # noqa: E731, B023
        triplets = edges.join(at("src"), "src").join(at("dst"), "dst")
        if active is not None:
            triplets = triplets.where(active(now))
        sent = [triplets.select(F.col(end).alias("id"), m.alias("_m")) for end, m in (("dst", to_dst), ("src", to_src)) if m is not None]
        messages = sent[0] if len(sent) == 1 else sent[0].unionAll(sent[1])
        merged = messages.where("_m is not null").groupBy("id").agg(merge(F.col("_m")).alias("_m"))
        new = update(F.col("_m"), now)
        state, row = loop.keep(state.join(merged, "id", "left").select("id", *(new.get(n, F.col(n)).alias(n) for n in names), F.col("_m").isNotNull().alias("_got")), F.sum(F.col("_got").cast("int")).alias("n"))
        state = state.drop("_got")
        empty = 0 if row.n else empty + 1
        if empty >= stop_after_empty:
            break
    return state
