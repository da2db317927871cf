"""Best-fit-decreasing packing of token pieces into windows of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, shuffle_partitions
from .tokens import token_pieces


class CapacityTree:
    """Segment tree over remaining capacities; a leaf is set while a window of that capacity is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)

    def put(self, capacity: int, is_open: bool) -> None:
        at = self.size + capacity
        self.open[at] = is_open
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """Least capacity of at least ``need`` that is open."""
        at = self.size + need
        if self.open[at]:
            return need
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.open[2 * at])
                return at - self.size
            at >>= 1
        return None


@dataclass
class Plan:
    """Runs of equal pieces by (length, rank), and ranges of windows with equal use.

    A run puts pieces of rank ``rank .. rank+count`` of its length into windows from
    ``window`` on, ``per`` to each, the first at ``offset``.
    """

    capacity: int
    runs: np.ndarray  # length, rank, count, window, per, offset
    ranges: np.ndarray  # first window, number of windows, ids in use

    @property
    def windows(self) -> int:
        return int(self.ranges[:, 1].sum())


def plan_windows(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram of lengths.

    Pieces of one length are equal to the packer, so windows with equal remaining capacity are
    kept as ranges and a whole range is filled in one step; the result is that of placing
    piece by piece. Input and work depend on ``capacity``, not on the number of pieces.
    """
    tree = CapacityTree(capacity)
    ranges: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, ...]] = []
    opened = 0

    def leave(left: int, first: int, n: int) -> None:
        if n:
            ranges.setdefault(left, []).append((first, n))
            tree.put(left, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        rank, total = 0, counts[length]
        while rank < total:
            left = tree.tightest(length)
            if left is None:
                left, per = capacity, capacity // length
                first, n = opened, -(-(total - rank) // per)
                opened += n
            else:
                first, n = ranges[left].pop()
                if not ranges[left]:
                    tree.put(left, False)
                per = left // length
            full = min(n, (total - rank) // per)
            offset = capacity - left
            if full:
                runs.append((length, rank, full * per, first, per, offset))
                leave(left - per * length, first, full)
                rank += full * per
            if full < n:
                rest = total - rank
                if rest:
                    runs.append((length, rank, rest, first + full, rest, offset))
                    leave(left - rest * length, first + full, 1)
                    rank = total
                leave(left, first + full + bool(rest), n - full - bool(rest))
    used = sorted((first, n, capacity - left) for left, found in ranges.items() for first, n in found)
    return Plan(capacity, np.array(sorted(runs), np.int64).reshape(-1, 6), np.array(used, np.int64).reshape(-1, 3))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Place pieces into windows of ``capacity`` ids.

    ``pieces`` has ``doc_id``, ``start`` and ``length`` (1 to ``capacity``); other columns stay, but for those with the
    names of new ones, which are replaced: ``sequence_id``, ``offset`` (gapless from 0 in each
    sequence), ``sequence_used`` and ``sequence_length`` (``capacity``, or the used length where
    that is a power of two, which needs no padding). Equal rows are placed each on its own.
    Pieces are ranked within their length by salted counts, so that a length that a third of all
    pieces have is spread over tasks; the driver gets one count per length.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset", "sequence_used", "sequence_length", "_salt", "_nth", "_before", "_rank")
    salts = max(64, shuffle_partitions(spark))
    others = [c for c in pieces.columns if c not in ("doc_id", "start", "length")]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    groups = checkpointed(groups)
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_windows(counts, capacity)
    before = groups.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", *others))
    ranked = salted.withColumn("_nth", nth).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_nth") - 1)
    runs, ranges = plan.runs, plan.ranges
    shift = 1 << 44
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] * shift + runs[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            run = runs[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            nth = rank - run[:, 1]
            sequence = run[:, 3] + nth // run[:, 4]
            offset = run[:, 5] + nth % run[:, 4] * length
            used = ranges[np.searchsorted(ranges[:, 0], sequence, side="right") - 1, 2]
            padded = np.where(used & (used - 1), capacity, used)
            new = [pa.array(x, pa.int64()) for x in (sequence, offset, used, padded)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *new], names=[*names, "sequence_id", "offset", "sequence_used", "sequence_length"])

    new_fields = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "sequence_used", "sequence_length")]
    schema = T.StructType([*pieces.schema.fields, *new_fields])
    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def sequences(placed: DataFrame, pad_id: int = 0) -> DataFrame:
    """One row per sequence with its padded ids, from placed pieces that still have ``ids``.

    A sequence has at most ``capacity`` pieces, so its group is bounded.
    """
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.col("sequence_length") - F.col("sequence_used")).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda x: x["ids"]), "")
    grouped = placed.groupBy("sequence_id", "sequence_used", "sequence_length").agg(joined.alias("_hex"))
    return grouped.select("sequence_id", "sequence_used", "sequence_length", F.unhex(F.concat("_hex", pad)).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, cut and pack documents; rows as of :func:`pack`, with ``ids_crc32`` in place of the ids.

    Null and empty texts are one piece, the end id. An empty table gives no rows. Repeated rows
    are packed as often as they occur. Columns other than id and text are not read.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, id_column, text_column)
    slim = checkpointed(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return pack(slim, capacity)
