import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamlog.schemas import CorruptBundle, InvalidRequest
from loamlog.sources import columnar, encoding, segments
from loamlog.sources.encoding import Message

T = 1_704_067_200_000
VECTORS = {
    "B1": ("10080000f451c28c010000016102026263", [(1, T, None, b"a"), (2, T, None, b"bc")], False),
    "B2": ("1d080100f451c28c010000026b310276310101f451c28c010000026b3100", [(1, T, b"k1", b"v1"), (2, T + 1, b"k1", b"")], False),
    "B3": ("27500a00000000000000040000f451c28c01000001780601790201017a0005f451c28c0100000177", [(10, T, None, b"x"), (11, T, None, b"y"), (13, T, None, b"z"), (15, T + 5, None, b"w")], True),
    "B4": ("144407000000000000000000f451c28c0100000171", [(7, T, None, b"q")], True),
    "B5": ("2a00100000f451c28c01000000020002000200020002000200020002000200020002000200020002000200", [(i + 1, T, None, b"") for i in range(16)], False),
    "B6": ("0b040000f451c28c01000000", [(1, T, None, b"")], False),
}


@pytest.mark.parametrize("name", VECTORS)
def test_byte_vectors(name):
    raw, rows, sparse = VECTORS[name]
    data, messages = bytes.fromhex(raw), [Message(*r) for r in rows]
    assert [m for b in encoding.decode_segment(data, 1, "error") for m in b] == messages
    assert encoding.encode_bundle(messages, sparse, snappy=False) == data
    for n in range(1, len(data)):
        assert list(encoding.decode_segment(data[:n], 1)) == []
        with pytest.raises(CorruptBundle):
            list(encoding.decode_segment(data[:n], 1, "error"))


@pytest.mark.parametrize(("value", "raw"), [(0, "00"), (127, "7f"), (128, "8001"), (16383, "ff7f"), (16384, "808001"), (2097151, "ffff7f"), (2097152, "80808001"), (268435455, "ffffff7f"), (268435456, "8080808001"), (4294967295, "ffffffff0f")])
def test_varint(value, raw):
    assert encoding.varint(value).hex() == raw
    assert encoding.read_varint(bytes.fromhex(raw), 0, len(raw) // 2) == (value, len(raw) // 2)


@pytest.mark.parametrize("head", [0x80 | 4, 4 | 2, 4 | 3])
def test_bad_headers(head):
    data = bytes([11, head]) + bytes.fromhex("0000f451c28c01000000")
    with pytest.raises(CorruptBundle):
        list(encoding.decode_segment(data, 1))


def test_more_messages_than_bytes():
    bundle = bytes([0]) + encoding.varint(5000) + b"\0" * 20
    with pytest.raises(CorruptBundle):
        list(encoding.decode_segment(encoding.varint(len(bundle)) + bundle, 1))


messages = st.lists(st.tuples(st.integers(1, 50), st.integers(0, 3), st.one_of(st.none(), st.binary(min_size=1, max_size=5)), st.binary(max_size=30)), min_size=1, max_size=40)


@settings(max_examples=150, deadline=None)
@given(messages, st.booleans())
def test_round_trip(rows, snappy):
    seq, ts, out = 0, 0, []
    for step, later, key, content in rows:
        seq, ts = seq + step, ts + later
        out.append(Message(seq, ts, key, content))
    frame = encoding.encode_bundle(out, sparse=True, snappy=snappy)
    assert list(encoding.decode_segment(frame, 1, "error")) == [out]
    dense = [Message(7 + i, m.ts_ms, m.key, m.content) for i, m in enumerate(out)]
    assert list(encoding.decode_segment(encoding.encode_bundle(dense, snappy=snappy), 7, "error")) == [dense]


@settings(max_examples=150, deadline=None)
@given(messages, st.integers(1, 9), st.booleans())
def test_columns_equal_messages(rows, size, dense):
    """The column-wise codec writes the bytes of the message-wise one, and reads them back."""
    seq, ts, out = 0, 0, []
    for step, later, key, content in rows:
        seq, ts = seq + (1 if dense else step), ts + later
        out.append(Message(seq, ts, key, content))
    starts = np.arange(0, len(out), size)
    number, times = (np.array([getattr(m, k) for m in out], np.int64) for k in ("seq", "ts_ms"))
    expected = np.concatenate([[1], number[starts[1:] - 1] + 1])
    keys, contents = (pa.array([getattr(m, k) for m in out], pa.binary()) for k in ("key", "content"))
    frames, sparse = columnar.encode_bundles(number, times, keys, contents, starts, expected)
    assert frames == [encoding.encode_bundle(out[a : a + size], bool(s)) for a, s in zip(starts.tolist(), sparse, strict=True)]
    data = b"".join(frames)
    assert [m for b in encoding.decode_segment(data, 1, "error") for m in b] == out
    found = columnar.joined(list(columnar.scan_bundles(data, 1, "error")))
    got = columnar.decode_bodies(found)
    assert got["seq"].tolist() == number.tolist() and got["ts_ms"].tolist() == times.tolist()
    assert columnar.column_of(found.data, got["at"], got["size"]).to_pylist() == contents.to_pylist()
    assert columnar.column_of(found.data, got["key_at"], got["key_size"], got["key_size"] == 0).to_pylist() == keys.to_pylist()
    low, high = seq // 3, seq // 2
    part = [h for h, _ in columnar.scan_bundles(data, 1, "error", low, high)]
    assert [h.first for h in part] == [h.first for h in found.headers if h.last >= low and h.first <= high]


@settings(max_examples=200, deadline=None)
@given(messages, st.integers(0, 2000), st.integers(0, 255))
def test_broken_bytes_are_faults_in_both_codecs(rows, place, byte):
    out = [Message(i + 1, 7 * i, key, content) for i, (_, _, key, content) in enumerate(rows)]
    data = bytearray(encoding.encode_bundle(out, snappy=False))
    data[place % len(data)] = byte
    found = []
    for read in (lambda: [m for b in encoding.decode_segment(bytes(data), 1, "error") for m in b], lambda: columnar.decode_bodies(columnar.joined(list(columnar.scan_bundles(bytes(data), 1, "error"))))["seq"].tolist()):
        try:
            got = read()
            found.append([m.seq for m in got] if got and isinstance(got[0], Message) else got)
        except CorruptBundle:
            found.append(None)
    assert found[0] == found[1]


def test_long_keys_are_a_fault():
    with pytest.raises(CorruptBundle):
        encoding.encode_bundle([Message(1, 1, b"k" * 256, b"")])
    with pytest.raises(CorruptBundle):
        columnar.encode_bundles(np.array([1]), np.array([1]), pa.array([b"k" * 256]), pa.array([b""]), np.array([0]), np.array([1]))


@pytest.mark.parametrize(("name", "want"), [("1-256_1704067200.ilog", ("sealed", 1, 256, 1704067200)), ("1-256.ilog", ("sealed", 1, 256, 0)), ("257_1704070800.log", ("active", 257, None, 1704070800)), ("257.log", ("active", 257, None, 0)), ("1.index", ("index", 1, None, 0)), ("1-256_1704067200.ilog.cleaned", ("transient", 0, None, 0)), ("1-2.ilog.swap", ("transient", 0, None, 0)), ("config", ("config", 0, None, 0)), ("x", ("other", 0, None, 0))])
def test_names(name, want):
    found = segments.parse_segment_name(name)
    assert (found.kind, found.base, found.last, found.created) == want


def test_wide_index_is_refused():
    with pytest.raises(InvalidRequest):
        segments.parse_segment_name("1_64.index")


@pytest.fixture
def folder(spark, tmp_path):
    rows = [("t", p, s, T + s, f"k{s % 3}" if s % 4 else None, "" if s % 5 == 0 else "c" * s, 20 * ((s - 1) // 20) + 1) for p in range(2) for s in range(1, 61) if s % 7]
    df = spark.createDataFrame(rows, "topic string, partition int, seq long, ts_ms long, key string, content string, segment_base long")
    segments.write_segments(df, str(tmp_path / "base"), bundle_messages=8, index_interval=100)
    return str(tmp_path / "base"), rows


def test_source_round_trip(spark, folder):
    path, rows = folder
    got = segments.read_segments(spark, path).collect()
    assert sorted((r.topic, r.partition, r.seq, r.ts_ms, r.key and bytes(r.key).decode(), bytes(r.content).decode(), r.segment_base) for r in got) == sorted(rows, key=lambda r: r[:3])
    assert sum("index" in f for _, _, fs in os.walk(path) for f in fs) == 6
    index = next(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".index"))
    entries = segments.read_index(open(index, "rb").read())
    assert entries[0][1] == 0 and entries == sorted(entries)


def test_files_are_pruned_by_name(spark, folder):
    path, _ = folder
    reader = segments.SegmentReader(None, {"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    assert list(reader.pushFilters([EqualTo(("topic",), "t"), EqualTo(("partition",), 1), GreaterThan(("seq",), 20), LessThanOrEqual(("seq",), 40)])) == [GreaterThan(("seq",), 20), LessThanOrEqual(("seq",), 40)]
    assert [(s.partition, s.base) for g in reader.partitions() for s in g.files] == [(1, 21)]
    assert segments.read_segments(spark, path).where("topic = 't' and partition = 1 and seq > 20 and seq <= 40").count() == 17  # without 21, 28 and 35


def test_verify_and_tails(spark, folder):
    path, _ = folder
    assert segments.verify_segments(spark, path).where("error is not null").count() == 0
    active = next(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".log"))
    sealed = next(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".ilog"))
    before = segments.read_segments(spark, path).count()
    os.truncate(active, os.path.getsize(active) - 1)
    assert 0 < segments.read_segments(spark, path).count() < before
    with pytest.raises(Exception, match="cut off"):
        segments.read_segments(spark, path, on_truncated="error").count()
    os.truncate(sealed, os.path.getsize(sealed) - 1)
    with pytest.raises(Exception, match="cut off"):
        segments.read_segments(spark, path).count()
    assert segments.verify_segments(spark, path).where("error is not null").count() == 2


def test_partitions_must_be_dense(spark, folder):
    path, _ = folder
    os.rename(f"{path}/t/1", f"{path}/t/2")
    with pytest.raises(InvalidRequest):
        segments.list_segments(path)


def test_large_sequence_numbers_are_refused():
    data = bytearray.fromhex(VECTORS["B4"][0])
    data[2:10] = struct.pack("<Q", 2**63)
    with pytest.raises(CorruptBundle):
        list(encoding.decode_segment(bytes(data), 1))


@pytest.fixture
def late_broadcast(spark):
    """Joins are planned by shuffles and turn into broadcasts at run time, as over tables above the size thresholds; their shuffles are then read where they lie."""
    found = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "64KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in found.items():
        spark.conf.set(key, value)
    yield
    for key in found:
        spark.conf.unset(key)


@pytest.fixture
def in_parts(spark, late_broadcast, tmp_path):
    """Segment files of 4,000 messages of two partitions, which lie in four files that cut segments."""
    rows = spark.range(4000, numPartitions=4).selectExpr("'t' AS topic", "cast(id % 2 AS int) AS partition", "id div 2 + 1 AS seq", f"{T} + 7919 * id % 100003 AS ts_ms", "cast(id AS string) AS key", "repeat(sha2(cast(id AS string), 256), 4) AS content")
    rows.selectExpr("*", "64 * ((seq - 1) div 64) + 1 AS segment_base", "16 * ((seq - 1) div 16) + 1 AS bundle_base").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    segments.write_segments(log, str(tmp_path / "base"))
    return log, str(tmp_path / "base")


def test_a_segment_is_verified_whole_however_its_rows_come(spark, in_parts):
    log, path = in_parts
    want = {(r.partition, r.segment_base, r.last, r.n) for r in log.groupBy("partition", "segment_base").agg(F.max("seq").alias("last"), F.count("*").alias("n")).collect()}
    found = segments.verify_segments(spark, path).collect()
    assert {(r.partition, r.base_seq, r.last_seq, r.messages) for r in found} == want
    assert not [r for r in found if r.error]
    names = {os.path.basename(s.path) for s in segments.list_segments(path)}
    spans = log.groupBy("partition", "segment_base").agg(F.max("seq").alias("last"), F.expr("min(ts_ms) div 1000").alias("at")).collect()
    assert names == {f"{r.segment_base}_{r.at}.log" if r.last == 2000 else f"{r.segment_base}-{r.last}_{r.at}.ilog" for r in spans}


def test_every_message_comes_back_however_its_rows_come(spark, in_parts):
    log, path = in_parts
    columns = ["topic", "partition", "seq", "ts_ms", "key", "content", "segment_base"]
    got = segments.read_segments(spark, path).select(*(F.col(c).cast("string") for c in columns)).collect()
    assert sorted(got) == sorted(log.select(*(F.col(c).cast("string") for c in columns)).collect())


def test_an_attempt_that_is_cut_short_leaves_nothing(spark, tmp_path, monkeypatch):
    rows = spark.range(4000, numPartitions=4).selectExpr("'t' AS topic", "cast(id % 2 AS int) AS partition", "id div 2 + 1 AS seq", f"{T} + 7919 * id % 100003 AS ts_ms", "cast(id AS string) AS key", "sha2(cast(id AS string), 256) AS content")
    rows = rows.selectExpr("*", "64 * ((seq - 1) div 64) + 1 AS segment_base")
    real = type(rows).mapInArrow

    def lost_first(self, func, schema, *args):
        """Each task has an attempt before whose input ends in the midst and whose rows are lost."""

        def run(batches):
            held = list(batches)
            for batch in func(iter([b.slice(0, len(b) // 2 + 5) for b in held[:1]])):
                pass
            yield from func(iter(held))

        return real(self, run, schema, *args)

    monkeypatch.setattr(type(rows), "mapInArrow", lost_first)
    segments.write_segments(rows, str(tmp_path / "base"))
    monkeypatch.undo()
    columns = ["topic", "partition", "seq", "ts_ms", "key", "content", "segment_base"]
    got = segments.read_segments(spark, str(tmp_path / "base")).select(*(F.col(c).cast("string") for c in columns)).collect()
    assert sorted(got) == sorted(rows.select(*(F.col(c).cast("string") for c in columns)).collect())
    assert len(segments.list_segments(str(tmp_path / "base"))) == 2 * 32
