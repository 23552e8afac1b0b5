"""Change streams from files, new keys, windows of event time."""

import datetime as dt

from tidemark.plans.engine import Engine
from tidemark.streaming.changes import NewKeys, follow, windowed

SCHEMA = "_seq long, _op string, id int, k int"


def test_a_stream_of_changes(spark, tmp_path):
    e = Engine(spark)
    e.create_table("t", "id int, k int", ["id"])
    v = e.create_view("n", "SELECT k, COUNT(*) AS n FROM t GROUP BY k")
    source = f"{tmp_path}/in"
    spark.createDataFrame([(0, "insert", 1, 1), (1, "insert", 2, 1), (2, "insert", 3, 2)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: follow(e, "t", spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), f"{tmp_path}/cp").awaitTermination()
    run()
    assert {r.k: r.n for r in v.scan().collect()} == {1: 2, 2: 1}
    spark.createDataFrame([(3, "delete", 1, None), (4, "upsert", 2, 7), (5, "delete", 2, None), (6, "insert", 2, 2)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    assert {r.k: r.n for r in v.scan().collect()} == {2: 2}


def test_new_keys(spark):
    found = []
    keys = NewKeys("k", lambda new: found.append(sorted(r.k for r in new.collect())))
    for batch in ([1, 1, 2, None], [2, 3], [1, 3]):
        keys(spark.createDataFrame([(k,) for k in batch], "k int"))
    assert found == [[1, 2], [3]]


def test_windows(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(at(1), "a"), (at(4), "a"), (at(6), "b")], "ts timestamp, kind string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(f"{tmp_path}/in")
    q = windowed(stream, "ts", "5 minutes", "1 minute", ["kind"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("w").collect()) == [("a", 2), ("b", 1)]
