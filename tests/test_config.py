import pytest

from loamlog.operators import config
from loamlog.sources import store

PARTS = "topic string, partition int"


def configs(spark, rows):
    return spark.createDataFrame(rows, "topic string, partition int, text string")


def test_partition_texts_go_over_those_of_topics(spark):
    parts = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], PARTS)
    found = config.effective_configs(parts, configs(spark, [("a", None, "log.segment.bytes=1m\nretention.segments.count=3"), ("a", 1, "log.segment.bytes=2m"), ("b", 0, "log.segment.bytes=1")]))
    got = {(r.topic, r.partition): (r.segment_bytes, r.retention_segments, r.fault) for r in found.collect()}
    assert got == {("a", 0): (1 << 20, 3, None), ("a", 1): (2 << 20, 3, None), ("b", 0): (1 << 30, 0, "1 is less than 64")}


def test_reload_changes_one_partition_or_nothing(spark):
    parts = spark.createDataFrame([("a", 0), ("a", 1)], PARTS)
    before = config.effective_configs(parts, configs(spark, [("a", None, "log.segment.bytes=1m")])).cache()
    good = config.reload_config(before, configs(spark, [("a", None, "log.segment.bytes=3m")]), "a", 1)
    assert {r.partition: r.segment_bytes for r in good.collect()} == {0: 1 << 20, 1: 3 << 20}
    bad = config.reload_config(before, configs(spark, [("a", None, "log.segment.bytes=x")]), "a", 1)
    assert {r.partition: (r.segment_bytes, r.fault is None) for r in bad.collect()} == {0: (1 << 20, True), 1: (1 << 20, False)}


def test_append_one_message_and_reset(spark, tmp_path):
    path = str(tmp_path / "log")
    store.append_log(spark.createDataFrame([("t x", p, s, s, "k", "c") for p in range(2) for s in (1, 2, 5)], "topic string, partition int, seq long, ts_ms long, key string, content string"), path)
    assert store.append_message(spark, path, "t x", 1, 9, None, "more") == 6
    assert store.append_message(spark, path, "t x", 2, 9, "k", "new") == 1
    assert store.reset_partition(spark, path, "t x", 0) and not store.reset_partition(spark, path, "t x", 7)
    assert sorted((r.partition, r.seq) for r in store.read_log(spark, path).collect()) == [(1, 1), (1, 2), (1, 5), (1, 6), (2, 1)]


def test_no_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(store.InvalidRequest):
        store.shared_folder(Session)
