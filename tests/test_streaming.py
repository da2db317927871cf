import os
import time

import pytest
from pyspark.sql import functions as F

from loamlog.schemas import InvalidRequest
from loamlog.sources import store
from loamlog.streaming import tail

SCHEMA = "topic string, partition int, seq long, ts_ms long, key string, content string"


def rows(lo, hi):
    return [("t", p, s, s, "k", f"c{s}") for p in range(2) for s in range(lo, hi)]


def test_drain_equals_batch(spark):
    df = spark.createDataFrame(rows(1, 40), SCHEMA)
    sources = spark.createDataFrame([("t", 0, 5), ("t", 1, 30)], "topic string, partition int, start_seq long")
    got = tail.drain(df, sources)
    assert sorted(got.collect()) == sorted(df.where("(partition = 0 and seq >= 5) or seq >= 30").collect())


def test_replication_goes_on_and_repeats_nothing(spark, tmp_path):
    source, out, offsets = (str(tmp_path / n) for n in ("source", "replica", "offsets"))
    spark.createDataFrame(rows(1, 20), SCHEMA).write.parquet(source)
    stream = tail.stream_log(spark, source, spark.createDataFrame([], SCHEMA).schema)
    tail.replicate(stream, out, offsets, availableNow=True).awaitTermination()
    assert spark.read.parquet(out).count() == 38
    spark.createDataFrame(rows(15, 30), SCHEMA).write.mode("append").parquet(source)
    tail.replicate(stream, out, offsets, availableNow=True).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 58 == got.select("partition", "seq").distinct().count()


KIND = "topic string, partition int, kind string, min_bytes long, max_wait_ms long, size long, seq long, above_mark long, segment_base long"


def test_long_poll(spark, tmp_path):
    feed = str(tmp_path / "feed")
    hour = 3_600_000
    asked = [("t", 0, "request", 100, hour, 0, 0, None, None), ("t", 1, "request", 100, 1, 0, 0, None, None), ("t", 2, "request", 10_000, hour, 0, 0, None, None), ("t", 3, "request", None, hour, 0, 0, 7, None)]
    spark.createDataFrame(asked, KIND).write.parquet(feed)
    stream = spark.readStream.schema(KIND).parquet(feed)
    run = tail.long_poll(stream).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="200 milliseconds").start()

    def answers(n):
        for _ in range(100):  # a query with processing-time timers always has a batch to run, so it is never idle
            found = {(r.partition, r.captured, r.high, r.timed_out, r.reason) for r in spark.sql("select * from answers").collect()}
            if len(found) >= n or not run.isActive:
                break
            time.sleep(0.3)
        return found

    def add(*rows):
        spark.createDataFrame(list(rows), KIND).coalesce(1).write.mode("append").parquet(feed)

    try:
        assert answers(1) == {(1, 0, 0, True, "timeout")}
        add(("t", 0, "message", 0, 0, 60, 1, None, 1), ("t", 0, "message", 0, 0, 60, 2, None, 1))
        assert (0, 120, 2, False, "bytes") in answers(2)
        add(("t", 2, "message", 0, 0, 5, 9, None, 1), ("t", 2, "message", 0, 0, 6, 10, None, 10), ("t", 3, "mark", 0, 0, 0, 7, None, None))
        assert (2, 11, 10, False, "segment") in answers(3)
        add(("t", 3, "mark", 0, 0, 0, 8, None, None))
        assert (3, 0, 8, False, "mark") in answers(4)
    finally:
        run.stop()


def test_marks_of_a_replication_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "FOLD", 2)
    source, out, offsets = (str(tmp_path / n) for n in ("source", "replica", "offsets"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for k in range(6):
        spark.createDataFrame(rows(10 * k + 1 - min(k, 1) * 5, 10 * k + 11), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        tail.replicate(tail.stream_log(spark, source, schema), out, offsets, availableNow=True).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 120 == got.select("partition", "seq").distinct().count()
    assert len([n for n in os.listdir(f"{offsets}-marks") if n.startswith("epoch=")]) <= 3


def test_store(spark, tmp_path):
    path = str(tmp_path / "log")
    store.append_log(spark.createDataFrame(rows(1, 10), SCHEMA), path)
    store.append_log(spark.createDataFrame(rows(10, 12), SCHEMA), path)
    back = store.read_log(spark, path)
    assert back.count() == 22 and dict(back.dtypes)["partition"] == "int"
    plan = back.where((F.col("topic") == "t") & (F.col("partition") == 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_create_topic(spark, tmp_path):
    store.create_topic(spark, str(tmp_path), "events", 3, 2)
    store.create_topic(spark, str(tmp_path), "more", 1)
    assert spark.read.parquet(f"{tmp_path}/partitions").count() == 4
    for name, n in (("events", 1), ("-a", 1), ("ok", 0), ("a.b", 2)):
        with pytest.raises(InvalidRequest):
            store.create_topic(spark, str(tmp_path), name, n)
