"""Schemas of the log and of its metadata tables, and typed faults."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_TP = (("topic", T.StringType()), ("partition", T.IntegerType()))
LOG = _fields(*_TP, ("seq", T.LongType()), ("ts_ms", T.LongType()), ("key", T.BinaryType()), ("content", T.BinaryType()), ("segment_base", T.LongType()), ("bundle_base", T.LongType()))
PRODUCE = _fields(*_TP, ("ts_ms", T.LongType()), ("key", T.BinaryType()), ("content", T.BinaryType()))
SEGMENTS = _fields(*_TP, ("base_seq", T.LongType()), ("last_seq", T.LongType()), ("created_ts", T.LongType()), ("size_bytes", T.LongType()), ("sealed", T.BooleanType()))
INDEX = _fields(*_TP, ("segment_base", T.LongType()), ("rel_seq", T.LongType()), ("offset", T.LongType()))
TOPICS = _fields(("name", T.StringType()), ("partitions", T.IntegerType()), ("enabled", T.BooleanType()), ("rf", T.IntegerType()))
PARTITIONS = _fields(*_TP, ("first_available", T.LongType()), ("high_water_mark", T.LongType()))
NODES = _fields(("id", T.IntegerType()), ("endpoint", T.StringType()), ("available", T.BooleanType()), ("blocked", T.BooleanType()))
REPLICAS = _fields(*_TP, ("node_id", T.IntegerType()), ("is_leader", T.BooleanType()), ("in_isr", T.BooleanType()), ("last_lsn", T.LongType()))

MAX_SEQ = 2**63 - 1
TP = ["topic", "partition"]


class Fault(Exception):
    """A request that can't be answered as it stands."""


class UnknownTopic(Fault):
    pass


class UnknownPartition(Fault):
    pass


class InvalidRequest(Fault):
    pass


class InvalidSeqNums(Fault):
    pass


class CorruptBundle(Fault):
    pass


class BoundaryCheck(Fault):
    """A sequence number out of range, with the range."""

    def __init__(self, first_available: int, high_water_mark: int):
        super().__init__(f"outside of [{first_available}, {high_water_mark}]")
        self.first_available, self.high_water_mark = first_available, high_water_mark
