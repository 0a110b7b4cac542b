"""Top N and connected groups against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from graphskein.llm.components import connected_groups
from graphskein.llm.topn import top_n, top_vertices


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain_top(data, n):
    out = []
    for g in {d[0] for d in data}:
        mine = {d for d in data if d[0] == g}
        out += sorted(mine, key=lambda d: (-d[2], d[1]))[:n]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_top_n_against_sorting(spark, n):
    r = random.Random(n)
    data = [(0 if r.random() < 0.5 else r.randrange(300), r.randrange(2000), float(r.randrange(6))) for _ in range(5000)]
    df = spark.createDataFrame(data, "g long, i long, s double")
    assert rows(top_n(df, "g", "i", "s", n)) == plain_top(data, n)


def test_top_n_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.lit(1.0).alias("s"))
        assert rows(top_n(df, "g", "id", "s", 20, salts=2)) == sorted((i % 3, i, 1.0) for i in range(60))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_top_n_special_values(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, 5, inf), (1, 4, 2.0), (1, 4, 2.0), (1, 3, nan), (1, None, 9.0), (None, 1, 9.0), (2, 1, None), (1, 2, 2.0), (3, 9, -inf)]
    df = spark.createDataFrame(data, "g long, i long, s double").withColumn("at", F.lit(1)).withColumn("rank", F.lit(2))
    assert rows(top_n(df, "g", "i", "s", 2)) == [(1, 2, 2.0), (1, 5, inf), (3, 9, -inf)]
    assert rows(top_n(df.limit(0), "g", "i", "s", 2)) == []
    words = spark.createDataFrame([("a", "x" * 100_000, 1), ("a", "", 1), ("a", "y", 0)], "g string, i string, s int")
    assert [r.i for r in top_n(words, "g", "i", "s", 1).collect()] == [""]
    with pytest.raises(ValueError):
        top_n(df, "g", "i", "s", 0)


def test_latest_run_counts(spark):
    c = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 20, 1), (3, None, 5), (3, 30, 1), (None, 1, 1)], "vertex long, community long, computed_at int")
    m = spark.createDataFrame([(1, 5.0, 1), (1, 1.0, 2), (2, 3.0, 1), (3, 1.0, 1), (3, float("nan"), 2), (4, 1.0, 1)], "vertex long, measure double, computed_at int")
    assert rows(top_vertices(c, m, 1).select("community", "vertex")) == [(20, 2), (30, 3)]


def plain_groups(pairs):
    up = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                up.setdefault(x, x)
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up)


def check_groups(spark, pairs, **how):
    df = spark.createDataFrame(pairs, "s_vertex long, d_vertex long").withColumn("component", F.lit("x")).withColumn("v", F.lit(1))
    assert rows(connected_groups(df, **how)) == plain_groups(pairs)


def test_groups_special_cases(spark):
    check_groups(spark, [(1, 2), (2, 1), (2, 1), (3, 3), (4, None), (None, 5), (None, None), (2, 9), (-7, 9)])
    check_groups(spark, [])
    check_groups(spark, [(None, None), (6, None)])


def test_long_chain_and_hub(spark):
    r = random.Random(1)
    names = r.sample(range(10_000), 400)
    check_groups(spark, list(zip(names, names[1:])) + [(20_000, 20_001 + i) for i in range(300)])


def test_random_groups(spark):
    r = random.Random(2)
    check_groups(spark, [(r.randrange(600), r.randrange(600)) for _ in range(350)], beta=0.8, rounds=3)
