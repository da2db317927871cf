"""Writing: sequence numbers, validation, bundles, segment rolls, mirroring and replication."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TP
from .scan import watermarks, with_number, with_previous

COMPRESS_MESSAGES, COMPRESS_BYTES = 512, 1024
MIRROR_MESSAGES, MIRROR_BYTES = 128, 4 << 20


def assign_sequences(rows: DataFrame, marks: DataFrame, arrival: str) -> DataFrame:
    """Number new messages of each partition on from its ``high_water_mark``, in order of ``arrival``, a number (see :func:`with_number`)."""
    joined = with_number(rows, arrival, "_nth").join(marks.select(*TP, "high_water_mark"), TP, "left")
    return joined.select(*rows.columns, (F.coalesce("high_water_mark", F.lit(0)) + F.col("_nth")).cast("long").alias("seq"))


def validate_produce(requests: DataFrame, partitions: DataFrame, marks: DataFrame) -> DataFrame:
    """``fault`` of each request ``first_seq``, ``last_seq`` (null: assigned by the log); null where it is fine."""
    known = partitions.select(*TP, F.lit(True).alias("_known"))
    topics = partitions.select("topic", F.lit(True).alias("_topic")).distinct()
    joined = requests.join(topics, "topic", "left").join(known, TP, "left").join(marks.select(*TP, "high_water_mark"), TP, "left")
    first, last = F.col("first_seq"), F.col("last_seq")
    bad = first.isNotNull() & ((first <= F.coalesce("high_water_mark", F.lit(0))) | (last < first))
    fault = F.when(F.col("_topic").isNull(), "UnknownTopic").when(F.col("_known").isNull(), "UnknownPartition").when(bad, "InvalidSeqNums")
    return joined.select(*requests.columns, fault.alias("fault"))


def validate_explicit(rows: DataFrame) -> DataFrame:
    """Messages with explicit sequence numbers that don't ascend strictly in order of ``arrival``."""
    return with_previous(rows, ["seq"], order="arrival").where(F.col("seq") <= F.col("prev_seq")).drop("prev_seq")


def bundle_codec(messages: Column, size: Column) -> Column:
    """``snappy`` for more than 512 messages or 1024 bytes of payload."""
    return F.when((messages > COMPRESS_MESSAGES) | (size > COMPRESS_BYTES), "snappy").otherwise("none")


def fixed_batches(rows: DataFrame, size: int, order: str = "seq") -> DataFrame:
    """``batch``: every ``size`` messages of a partition, in order."""
    numbered = with_number(rows, order, "_nth")
    return numbered.withColumn("batch", F.floor((F.col("_nth") - 1) / size).cast("long")).drop("_nth")


def _starts(sizes: np.ndarray, max_messages: int, max_bytes: int, reached: bool, held: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """Where batches start among rows of one partition, and messages and bytes of the last; ``held`` are those of the batch before the first row.

    One step of the loop is a batch: cumulative sizes tell where the next one starts.
    """
    ends = np.cumsum(sizes)
    side = "left" if reached else "right"
    n, total = held
    starts, at = [], 0
    while True:
        before = int(ends[at - 1]) if at else 0
        # rows that still go into this batch, whose last may cross the limit
        full = (total >= max_bytes if reached else total > max_bytes) if n else False
        more = 0 if full else min(max_messages - n, int(np.searchsorted(ends[at:], before + max_bytes - total, side)) + 1)
        to = min(len(sizes), at + more)
        n, total = n + to - at, total + (int(ends[to - 1]) - before if to > at else 0)
        if to == len(sizes):
            return np.array(starts, np.int64), (n, total)
        starts.append(to)
        at, n, total = to, 0, 0


def greedy_batches(rows: DataFrame, max_messages: int, max_bytes: int, size: str = "size", order: str = "seq", within: Sequence[str] = (), reached: bool = True) -> DataFrame:
    """``batch``: a new one once the current has ``max_messages`` messages or its bytes reach ``max_bytes`` (with ``reached`` False: exceed it); the message that does stays.

    What a batch starts with depends on all before it, so a partition (or what ``within`` names in it) is walked in order, with no more state than
    the current batch's sums; numpy finds each next start in one step.
    """
    groups = [*TP, *within]
    names = [*groups, order, size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, batch_no, held = None, 0, (0, 0)
        for b in batches:
            if not len(b):
                continue
            out = np.zeros(len(b), np.int64)
            codes = np.zeros(len(b), np.int64)
            for c in groups:
                code = b[c].dictionary_encode()
                codes = codes * (len(code.dictionary) + 1) + pc.fill_null(code.indices, len(code.dictionary)).to_numpy(zero_copy_only=False)
            sizes = b[size].to_numpy(zero_copy_only=False).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(b)]
            for a, e in zip(edges[:-1], edges[1:], strict=True):
                own = tuple(b[c][a].as_py() for c in groups)
                if own != key:
                    key, batch_no, held = own, 0, (0, 0)
                starts, held = _starts(sizes[a:e], max_messages, max_bytes, reached, held)
                out[a + starts] = 1
                out[a:e] = batch_no + np.cumsum(out[a:e])
                batch_no = int(out[e - 1])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(out)], names=[*names, "batch"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", batch long"
    dealt = rows.select(*names).repartition(*groups).sortWithinPartitions(*groups, order)
    return dealt.mapInArrow(run, schema)


def roll_due(size_bytes: Column, index_bytes: Column, created_ts: Column, now: int, max_bytes: int, max_index_bytes: int, jitter_secs: Column, max_age_secs: int | None = None) -> Column:
    """Whether an active segment has to be sealed before the next append; an empty one never has.

    It is over ``max_bytes``, its index is over ``max_index_bytes``, or it is older than its own ``jitter_secs`` (0: never; see :func:`roll_jitter`). An age limit
    of the configuration counts only where the caller asks for it.
    """
    age = F.greatest(F.lit(now) - created_ts, F.lit(0))
    due = (size_bytes > max_bytes) | (index_bytes > max_index_bytes) | ((jitter_secs > 0) & (age > jitter_secs))
    if max_age_secs is not None:
        due = due | (age > max_age_secs)
    return (size_bytes > 0) & due


def roll_jitter(jitter_secs: int, seed: Column) -> Column:
    """Seconds after which a segment may be sealed: a week without jitter, else spread below ``jitter_secs`` by a hash of ``seed``, an hour at least."""
    if not jitter_secs:
        return F.lit(7 * 86400)
    return F.greatest(F.pmod(F.xxhash64(seed), F.lit(jitter_secs)), F.lit(3600)).cast("int")


def roll_segments(bundles: DataFrame, max_bytes: int) -> DataFrame:
    """``segment``: number of the segment that each bundle goes to; it rolls before a bundle when the segment is over ``max_bytes`` already."""
    return greedy_batches(bundles, 1 << 62, max_bytes, "bytes", "bundle_base", reached=False).withColumnRenamed("batch", "segment")


def seal_segments(bundles: DataFrame, max_bytes: int) -> DataFrame:
    """Segments after rolling: ``base_seq``, ``last_seq``, ``size_bytes``, ``frozen_ts`` (of the last append, in seconds) and ``sealed``.

    ``bundles`` has ``bundle_base``, ``last_seq``, ``bytes`` and ``ts_ms``. The last segment of a partition stays active: its ``last_seq`` is that so far and it isn't frozen. The result
    is what :func:`loamlog.operators.maintenance.retention` checks after a roll.
    """
    numbered = roll_segments(bundles, max_bytes).select(*TP, "bundle_base", "segment").join(bundles, [*TP, "bundle_base"])
    found = numbered.groupBy(*TP, "segment").agg(F.min("bundle_base").alias("base_seq"), F.max("last_seq").alias("last_seq"), F.sum("bytes").cast("long").alias("size_bytes"), F.floor(F.max("ts_ms") / 1000).cast("long").alias("frozen"))
    sealed = F.col("segment") < F.max("segment").over(Window.partitionBy(*TP))  # a row a segment
    return found.select(*TP, "base_seq", "last_seq", "size_bytes", F.when(sealed, F.col("frozen")).alias("frozen_ts"), sealed.alias("sealed"))


def sparse_index(bundles: DataFrame, interval: int = 4096) -> DataFrame:
    """Bundles that get an index entry: a segment's first, and each once more than ``interval`` bytes have passed since the last entry.

    ``bundles`` has ``segment_base``, ``bundle_base`` and ``bytes``.
    """
    parts = greedy_batches(bundles, 1 << 62, interval, "bytes", "bundle_base", ("segment_base",), reached=False)
    w = Window.partitionBy(*TP, "segment_base").orderBy("bundle_base")  # a segment's bundles
    placed = parts.select(*TP, "segment_base", "bundle_base", "batch", (F.sum("bytes").over(w) - F.col("bytes")).cast("long").alias("offset"), F.lag("batch").over(w).alias("before"))
    return placed.where("before is null or batch <> before").select(*TP, "segment_base", (F.col("bundle_base") - F.col("segment_base")).alias("rel_seq"), "offset")


def mirror_delta(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Messages of ``source`` beyond each partition's last one in ``destination``; sequence numbers stay."""
    marks = watermarks(destination).select(*TP, F.col("high_water_mark").alias("_high"))
    return source.join(marks, TP, "left").where(F.col("seq") > F.coalesce("_high", F.lit(0))).drop("_high")


def partition_mismatches(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Topics of ``source`` whose number of partitions differs at the destination, which can't be mirrored."""
    a = source.groupBy("topic").agg(F.count_distinct("partition").alias("source_partitions"))
    b = destination.groupBy("topic").agg(F.count_distinct("partition").alias("destination_partitions"))
    both = a.join(b, "topic", "left").withColumn("destination_partitions", F.coalesce("destination_partitions", F.lit(0)))
    return both.where("source_partitions <> destination_partitions")


def replicate(rows: DataFrame, size: int = MIRROR_MESSAGES) -> DataFrame:
    """Bundles of at most ``size`` messages as a replica stores them: range, messages, and whether there is a gap within or before the bundle."""
    numbered = fixed_batches(with_previous(rows.select(*TP, "seq"), ["seq"]), size)
    gap = F.coalesce(F.max((F.col("seq") != F.col("prev_seq") + 1).cast("int")), F.lit(0)) == 1
    return numbered.groupBy(*TP, "batch").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("messages"), gap.alias("sparse"))


def mirror_bundles(rows: DataFrame, marks: DataFrame | None = None, max_messages: int = MIRROR_MESSAGES, max_bytes: int = MIRROR_BYTES) -> DataFrame:
    """Bundles of a mirror: at most ``max_messages`` messages, closed once keys and contents reach ``max_bytes``.

    A bundle is ``sparse`` if one of its messages doesn't follow the message before it; the first one of a partition is expected
    after the destination's ``high_water_mark`` of ``marks``, or at 1.
    """
    size = F.octet_length(F.col("content").cast("binary")) + F.coalesce(F.octet_length(F.col("key").cast("binary")), F.lit(0))
    batches = greedy_batches(rows.select(*TP, "seq", size.cast("long").alias("size")), max_messages, max_bytes)
    follows = with_previous(batches, ["seq"])
    high = F.lit(0)
    if marks is not None:
        follows, high = follows.join(marks.select(*TP, F.col("high_water_mark").alias("_high")), TP, "left"), F.coalesce("_high", F.lit(0))
    gap = F.max((F.col("seq") != F.coalesce("prev_seq", high) + 1).cast("int")) == 1
    return follows.groupBy(*TP, "batch").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("messages"), F.sum("size").cast("long").alias("bytes"), gap.alias("sparse"))


def key_value_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Split ``key=value`` arguments at the first ``=``; without one all is content and there is no key."""
    at = F.instr(column, "=")
    key = F.when(at > 1, F.expr(f"substring({column}, 1, instr({column}, '=') - 1)"))
    content = F.when(at > 0, F.expr(f"substring({column}, instr({column}, '=') + 1)")).otherwise(F.col(column))
    return lines.withColumns({"key": key, "content": content})


def explicit_steps(rows: DataFrame, order: str, base_seq: int, seq_step: int, base_ts: int, ts_step: int) -> DataFrame:
    """Sequence numbers and times in steps, as for a generated series of messages."""
    numbered, nth = with_number(rows, order, "_nth"), F.col("_nth") - 1
    return numbered.withColumns({"seq": (nth * seq_step + base_seq).cast("long"), "ts_ms": (nth * ts_step + base_ts).cast("long")}).drop("_nth")
