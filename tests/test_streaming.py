"""Streams give what the whole table gives."""

from datetime import datetime

from graphskein.operators.skew import last_by_key
from graphskein.streaming.edges import keep_last_by_key, read_last, windowed_degrees


def test_last_by_key_over_a_stream(spark, tmp_path):
    kind = "edge_id long, subject long, objectuid long, seen_at timestamp"
    rows = [(i, i % 3, i % 5, datetime(2024, 1, 1 + (i * 7) % 20)) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        keep_last_by_key(stream, ["subject", "objectuid"], str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(60)
    got = sorted((r.ref_field, r.uid, r.edge_id) for r in read_last(spark, str(tmp_path / "out"), 2).collect())
    assert got == sorted(map(tuple, last_by_key(spark.createDataFrame(rows, kind), ["subject", "objectuid"]).collect()))


def test_last_edges_without_id_or_with_several_times(spark, tmp_path):
    kind = "edge_id long, subject long, objectuid long, seen_at timestamp"
    day = lambda d: datetime(2024, 1, d)
    spark.createDataFrame([(None, 1, 2, day(5)), (7, 1, 3, day(1)), (7, 4, 3, day(9))], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    keep_last_by_key(stream, ["subject", "objectuid"], str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(60)
    got = {(r.ref_field, r.uid): (r.edge_id, r.seen_at) for r in read_last(spark, str(tmp_path / "out"), 0).collect()}
    assert got == {("subject", 1): (None, day(5)), ("subject", 4): (7, day(9)), ("objectuid", 2): (None, day(5)), ("objectuid", 3): (7, day(9))}
    later = spark.createDataFrame([(7, 1, 3, day(1)), (7, 4, 5, day(9))], kind)
    assert {(r.uid, r.seen_at) for r in last_by_key(later, ["subject"], with_time=True).collect()} == {(1, day(1)), (4, day(9))}


def test_windowed_degrees(spark, tmp_path):
    kind = "src long, dst long, at timestamp"
    spark.createDataFrame([(1, 2, datetime(2024, 1, 1, 0, 10)), (1, 3, datetime(2024, 1, 1, 0, 50)), (2, 1, datetime(2024, 1, 1, 1, 5)), (None, 1, datetime(2024, 1, 1, 1, 5))], kind).write.parquet(str(tmp_path / "in"))
    q = windowed_degrees(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "at").writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start.hour, r.id, r.inDegree, r.outDegree) for r in spark.table("degrees").collect()}
    assert got == {(0, 1, 0, 2), (0, 2, 1, 0), (0, 3, 1, 0), (1, 2, 0, 1), (1, 1, 1, 0)}
