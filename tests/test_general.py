"""Broken references, wide tables, skewed keys: special cases on small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphskein.operators.pivot import attributes_to_wide, time_of, wide_to_cells
from graphskein.operators.references import broken_by_month, broken_references, parent_runs
from graphskein.operators.skew import key_summary, last_by_key, salted_aggregate
from graphskein.plans.heavy import heavy_keys

EDGE = "edge_id long, subject long, objectuid long, seen_at timestamp_ntz, reason string, run int"
VERTEX = "id long, created_at timestamp_ntz, deleted_at timestamp_ntz, uid string"


def at(day, month=1):
    return datetime(2024, month, day)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_broken_references(spark):
    vertices = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (2, at(5), None, None), (3, at(1), at(10), None), (None, None, None, None), (-70000, None, at(2), None), (5, at(9), at(3), None)], VERTEX)
    edges = spark.createDataFrame(
        [(10, 1, 2, at(4), "r", 1), (10, 1, 2, at(4), "r", 1), (11, 3, 4, at(10), None, None), (12, None, -70000, at(1, 2), None, None), (13, 1, 2**60, at(7), None, None), (14, 3, 2, None, None, None), (15, 5, None, at(5), None, None), (16, 9, None, None, None, None)],
        EDGE,
    )
    want = [(10, "objectuid", "late", "2024-01"), (11, "objectuid", "missing", "2024-01"), (11, "subject", "deleted", "2024-01"), (12, "objectuid", "deleted", "2024-02"), (13, "objectuid", "missing", "2024-01"), (15, "subject", "deleted", "2024-01"), (15, "subject", "late", "2024-01"), (16, "subject", "missing", "")]
    for share in (0.001, 0.2):
        assert rows(broken_references(edges, vertices, share=share)) == want
    assert rows(broken_by_month(broken_references(edges, vertices)).where("reason = 'late'")) == [("dgraph_edge", "objectuid", "late", "2024-01", 1), ("dgraph_edge", "subject", "late", "2024-01", 1)]


def test_broken_references_of_empty_tables(spark):
    vertices, edges = spark.createDataFrame([], VERTEX), spark.createDataFrame([], EDGE)
    assert rows(broken_references(edges, vertices)) == []
    one = spark.createDataFrame([(1, 2, None, at(1), None, None)], EDGE)
    assert rows(broken_references(one, vertices)) == [(1, "subject", "missing", "2024-01")]


def test_runs_are_cut_at_blocks(spark):
    v = spark.range(10, 21).select("id", F.lit(1).alias("born"), F.lit(2).alias("died")).where("id <> 13")
    assert rows(parent_runs(v, bits=4).select("first", "last")) == [(10, 12), (14, 15), (16, 20)]


TRIPLE = "triple_id long, subject long, predicate string, objectstring string, objectlong long, objectdouble double, objecttimestamp timestamp_ntz, objectboolean boolean, objectgeo string, objectpassword string, objecttype string, read_at timestamp_ntz, pos int"


def triple(i, subject, predicate, text=None, read=1, **typed):
    return (i, subject, predicate, text, typed.get("long"), typed.get("double"), typed.get("time"), typed.get("bool"), typed.get("geo"), typed.get("password"), "string", at(read), 7)


@pytest.fixture(scope="module")
def declared(spark):
    return spark.createDataFrame([("age", "long"), ("score", "double"), ("on", "boolean"), ("joined", "timestamp"), ("name", "string"), ("place", "geo"), ("friend", "uid")], "predicate string, objecttype string")


def test_wide_table(spark, declared):
    data = [
        triple(1, 1, " AGE ", "12"), triple(2, 1, "age", "+0013", 2), triple(3, 1, "age", "9223372036854775808", 3), triple(4, 1, "age", "n/a", 4), triple(5, 1, "age", "  ", 2, long=14),
        triple(6, 1, "score", "1e-1"), triple(7, 2, "score", None, long=3), triple(8, 2, "score", None, 0 + 1, double=float("nan")), triple(9, 1, "score", ".5.", 5),
        triple(10, 1, "on", " TRUE "), triple(11, 2, "on", "yes"), triple(12, 2, "on", None, bool=False),
        triple(13, 1, "joined", "2024-02-30", 9), triple(14, 1, "joined", "2024-02-28T23:30:00-01:00"), triple(15, 2, "joined", " 2024-02-28 "),
        triple(16, 1, "name", "  a b "), triple(17, 1, "name", "  ", 8), triple(18, 2, "place", None, geo="{}"), triple(19, 3, "nope", "1"), triple(20, 4, "friend", "1"), triple(21, None, "age", "1"),
    ]
    triples = spark.createDataFrame([*data, data[0]], TRIPLE)
    wide = attributes_to_wide(triples, declared)
    assert wide.columns == ["subject", "age", "joined", "name", "on", "place", "score"]
    assert dict(wide.dtypes)["joined"] == "timestamp_ntz" and dict(wide.dtypes)["age"] == "bigint"
    got = {r.subject: tuple(r)[1:] for r in wide.collect()}
    assert got == {1: (14, datetime(2024, 2, 29, 0, 30), "  a b ", True, None, 0.1), 2: (None, datetime(2024, 2, 28), None, False, "{}", 3.0), 3: (None,) * 6, 4: (None,) * 6}
    cells = rows(wide_to_cells(wide))
    assert (1, "score", "0.100") in cells and (2, "joined", "2024-02-28 00:00:00") in cells and (1, "on", "true") in cells and len(cells) == 9


def test_wide_table_of_nothing(spark, declared):
    empty = spark.createDataFrame([], TRIPLE)
    assert attributes_to_wide(empty, declared).count() == 0
    with pytest.raises(ValueError):
        attributes_to_wide(empty, spark.createDataFrame([("subject", "long")], "predicate string, objecttype string"))
    assert "x_subject" in attributes_to_wide(empty, spark.createDataFrame([("subject", "long")], "predicate string, objecttype string"), prefix="x_").columns


def test_time_notations(spark):
    texts = ["2024-01-02", "2024-01-02T03:04:05", "2024-01-02 03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04", "2024-01-02T03:04:05.5", "2024-1-2", "0000-00-00", "2024-01-02T25:00:00"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(time_of(F.col("t"))).collect()]
    assert got == [datetime(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 1, 4, 5)] + [None] * 5


def test_last_by_key(spark):
    e = spark.createDataFrame([(1, 7, 8, at(1)), (2, 7, None, at(2)), (3, 7, 8, at(2)), (3, 7, 8, at(2)), (4, 9, 7, None), (None, 9, None, None)], "edge_id long, subject long, objectuid long, seen_at timestamp_ntz").withColumn("uid", F.lit("x")).withColumn("_salt", F.lit(1))
    want = [("objectuid", 7, 4), ("objectuid", 8, 3), ("subject", 7, 3), ("subject", 9, 4)]
    for share in (0.001, 0.3):
        assert rows(last_by_key(e, ["subject", "objectuid"], share=share)) == want
    assert rows(last_by_key(e.limit(0), ["subject", "objectuid"])) == []
    assert ("subject", 7, 4, at(1), at(2)) in rows(key_summary(e, ["subject"]))


def test_salting_spreads_heavy_keys_only(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 6_000, 1).otherwise(F.col("id")).alias("k"), "id")
    assert heavy_keys(df, "k", share=0.01) == [1]
    assert heavy_keys(df.limit(0), "k", share=0.01) == []
    out = salted_aggregate(df, ["k"], [F.count("*").alias("n")], [F.sum("n").alias("n")], salt_by="k", spread_by=["id"], share=0.01)
    assert out.where("k = 1").first().n == 6_000 and out.count() == 4_001
