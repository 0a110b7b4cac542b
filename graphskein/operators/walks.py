"""Random walks."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.plans.scratch import cut, drop

#: Steps whose ended walkers are stored together.
MERGE = 32


def sample_by_walks(g: Graph, sample_size: int = 1, init_temperature: float = 2.3, seed: int = 7, max_steps: int | None = None) -> DataFrame:
    """``id, samples``: per vertex the vertices where ``sample_size`` continuous-time random walks from it end.

    A walker goes to a random neighbour (edges count in both directions and as often as they stand there), and on each
    arrival, as at the start, its temperature falls by -ln(U) / degree; it ends where that makes it 0 or less. An isolated vertex's
    walks end at once. The same ``seed`` gives the same walks. All walks are followed to their ends; with ``max_steps``, walkers
    that still move after as many steps are an error."""
    e = g.directed(True).select("src", "dst").where("src <> dst")
    numbered = cut(e.withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1))
    deg = cut(numbered.groupBy(F.col("src").alias("at")).agg(F.count("*").alias("deg")))
    walkers = g.ids.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(sample_size))).alias("k")).select("start", "k", F.col("start").alias("at"), F.lit(float(init_temperature)).alias("t"))
    moving, ended, read, old = cut(walkers), [], [], []
    for step in count():
        if step == max_steps:
            raise RuntimeError(f"walkers still move after {max_steps} steps")
        draw = lambda salt: (F.shiftrightunsigned(F.xxhash64("start", "k", F.lit(step), F.lit(seed), F.lit(salt)), 11).cast("double") + 1) / float(2**53 + 1)  # noqa: E731, B023
        cooled = cut(moving.join(deg, "at", "left").withColumn("t", F.when(F.col("deg").isNull(), 0.0).otherwise(F.col("t") + F.log(draw(0)) / F.col("deg"))))
        ended.append(cooled.where("t <= 0").select("start", "k", "at"))
        read.append(cooled)
        if len(ended) == MERGE:
            ended, old = [merged := cut(reduce(DataFrame.unionAll, ended))], read
            read = [merged]
        going = cooled.where("t > 0").withColumn("i", F.least(F.floor(draw(1) * F.col("deg")), F.col("deg") - 1).cast("int"))
        new = cut(going.join(numbered, (F.col("at") == F.col("src")) & (going.i == numbered.i)).select("start", "k", F.col("dst").alias("at"), "t"))
        drop(moving, *old)
        moving, old = new, []
        if not moving.limit(1).count():
            break
    return reduce(DataFrame.unionAll, ended).groupBy(F.col("start").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "at"))), lambda s: s["at"]).alias("samples"))
