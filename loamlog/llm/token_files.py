"""Token-id shards in patched frame-of-reference blocks.

A shard is one file:

- ``PFORIDS1``
- blocks of ``BLOCK`` ids (the last may have fewer): minimum u32, width u8, zero u8, number of
  exceptions u16, number of ids u32, packed values (``BLOCK * width / 8`` bytes), positions of the
  exceptions u16 each, their high bits u32 each. A value is ``minimum + (low bits | high << width)``.
- documents: doc_id i64 each, number of ids i64 each, null flags u8 each
- index: start of each block u64
- footer: documents, ids, blocks, start of the documents, start of the index, as u64; ``PFORIDS1``

All numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_array, bound_batches, byte_slices, checkpointed, open_fs, shared_path
from .tokens import with_end, word_encoder

MAGIC = b"PFORIDS1"
BLOCK = 512
PERCENTILE = 0.95
HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2"), ("count", "<u4")])
FOOTER = struct.Struct("<5Q8s")


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value below 2**32 needs."""
    return np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0).astype(np.int64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values as rows of ``BLOCK * width / 64`` words, lowest bits first."""
    rows = len(values)
    lanes = np.ascontiguousarray(values.reshape(rows * BLOCK // 64, 64).T)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(rows, -1)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    """The reverse of :func:`pack_bits`."""
    rows = len(words)
    lanes = np.ascontiguousarray(words.reshape(rows * BLOCK // 64, width).T)
    out = np.empty((64, lanes.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | lanes[word + 1] << np.uint64(64 - shift)
        out[j] = value & mask
    return np.ascontiguousarray(out.T).reshape(rows, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of ids, each packed at the width that ``percentile`` of its values need."""
    count = len(ids)
    if not count:
        return []
    rows = -(-count // BLOCK)
    counts = np.full(rows, BLOCK)
    counts[-1] = count - BLOCK * (rows - 1)
    table = np.full(rows * BLOCK, ids[BLOCK * (rows - 1) :].min(), np.uint64)
    table[:count] = ids
    table = table.reshape(rows, BLOCK)
    minimum = table.min(axis=1)
    table -= minimum[:, None]
    nth = min(BLOCK - 1, int(BLOCK * percentile))
    widths = bit_lengths(np.partition(table, nth, axis=1)[:, nth])
    high = table >> widths.astype(np.uint64)[:, None]
    out: list[bytes] = [b""] * rows
    heads = np.zeros(rows, HEAD)
    heads["minimum"], heads["width"], heads["count"] = minimum, widths, counts
    row, at = np.nonzero(high)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    heads["exceptions"] = np.diff(bounds)
    position, patch = at.astype("<u2"), high[row, at].astype("<u4")
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        low = table[own] & np.uint64((1 << int(width)) - 1)
        packed = pack_bits(low, int(width)).astype("<u8") if width else np.empty((len(own), 0), "<u8")
        for k, r in enumerate(own):
            a, b = bounds[r], bounds[r + 1]
            out[r] = heads[r].tobytes() + packed[k].tobytes() + position[a:b].tobytes() + patch[a:b].tobytes()
    return out


def decode_blocks(data: bytes | memoryview, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at ``starts`` of ``data``."""
    rows = len(starts)
    if not rows:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(HEAD.itemsize)].reshape(-1).view(HEAD)
    widths = heads["width"].astype(np.int64)
    table = np.zeros((rows, BLOCK), np.uint64)
    body = starts + HEAD.itemsize
    for width in np.unique(widths):
        if width:
            own = np.flatnonzero(widths == width)
            words = raw[body[own][:, None] + np.arange(BLOCK * width // 8)].reshape(-1).view("<u8").reshape(len(own), -1)
            table[own] = unpack_bits(words, int(width))
    for r in np.flatnonzero(heads["exceptions"]):
        n, at = int(heads["exceptions"][r]), int(body[r] + BLOCK * widths[r] // 8)
        position = np.frombuffer(data, "<u2", n, at)
        table[r, position] |= np.frombuffer(data, "<u4", n, at + 2 * n).astype(np.uint64) << np.uint64(widths[r])
    table += heads["minimum"].astype(np.uint64)[:, None]
    keep = np.arange(BLOCK) < heads["count"][:, None]
    return table[keep].astype("<u4")


class ShardWriter:
    """Writes a shard as a stream; keeps only counts of its documents and starts of its blocks."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.rest = np.empty(0, np.uint32)
        self.ids = 0
        self.starts: list[int] = []
        self.documents: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _blocks(self, ids: np.ndarray) -> None:
        blocks = encode_blocks(ids)
        for block in blocks:
            self.starts.append(self.at)
            self.at += len(block)
        self.out.write(b"".join(blocks))

    def add(self, doc_ids: pa.Array, flat: np.ndarray, counts: np.ndarray) -> None:
        nulls = doc_ids.is_null().to_numpy(zero_copy_only=False)
        self.documents.append((doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), counts.astype("<i8"), nulls.astype("u1")))
        self.ids += len(flat)
        flat = np.concatenate([self.rest, flat])
        whole = len(flat) // BLOCK * BLOCK
        self._blocks(flat[:whole])
        self.rest = flat[whole:]

    def close(self) -> int:
        self._blocks(self.rest)
        documents = self.at
        for k in range(3):
            for part in self.documents:
                self._put(part[k].tobytes())
        index = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(FOOTER.pack(sum(len(x[0]) for x in self.documents), self.ids, len(self.starts), documents, index, MAGIC))
        return self.at


def read_shard(file, size: int, group: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of a shard in its order, some at a time: ids, null flags, number of ids, and all their token ids."""
    file.seek(size - FOOTER.size)
    n, ids, blocks, documents, index, magic = FOOTER.unpack(file.read(FOOTER.size))
    file.seek(0)
    if magic != MAGIC or file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id shard")
    file.seek(documents)
    doc_ids, counts = np.frombuffer(file.read(8 * n), "<i8"), np.frombuffer(file.read(8 * n), "<i8")
    nulls = np.frombuffer(file.read(n), "u1")
    starts = np.append(np.frombuffer(file.read(8 * blocks), "<u8").astype(np.int64), documents)
    if counts.sum() != ids:
        raise ValueError("a shard's counts do not add up")
    ends = np.cumsum(counts)
    rest, at, given = [], 0, 0
    for b in range(0, blocks, group):
        to = min(blocks, b + group)
        file.seek(int(starts[b]))
        rest.append(decode_blocks(file.read(int(starts[to] - starts[b])), starts[b:to] - starts[b]))
        have = given + sum(map(len, rest))
        until = int(np.searchsorted(ends, have, side="right"))
        if until > at:
            flat = np.concatenate(rest)
            used = int(ends[until - 1]) - given
            yield doc_ids[at:until], nulls[at:until], counts[at:until], flat[:used]
            rest, given, at = [flat[used:]], int(ends[until - 1]), until
    if at < n:
        yield doc_ids[at:], nulls[at:], counts[at:], np.empty(0, "<u4")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Encode documents and write their ids in ascending order of id; returns the manifest.

    Rows of the manifest: ``path``, ``size``, ``shard`` (ascending with doc_id), ``documents``
    and ``ids``. Texts are dealt by ranges of doc_id before they are encoded; a repeated doc_id is
    ordered by a hash of its text, so it can be split too. Each attempt of a task writes a file of its
    own and only the manifest, which is checkpointed, says which files count, so a lost executor
    costs its tasks and leaves no half file behind. Null doc_ids come first, null texts count as
    empty, an empty table gives an empty manifest. Other columns are not read.
    """
    base = path or shared_path(docs.sparkSession, "token-ids")
    rows = bound_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        target = f"{base}/{shard:06d}-{uuid.uuid4().hex}.pfor"
        encoder = writer = out = None
        documents = 0
        for batch in batches:
            for part in byte_slices(batch, "text"):
                if writer is None:
                    fs, at = open_fs(target)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                    encoder, writer = word_encoder(tokenizer_path), ShardWriter(out)
                writer.add(part["doc_id"], *with_end(*encoder.encode(part["text"]), end_id))
                documents += len(part)
        if writer is not None:
            size = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [target], "size": [size], "shard": [shard], "documents": [documents], "ids": [writer.ids]})

    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(dealt.mapInArrow(write, "path string, size long, shard long, documents long, ids long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of a manifest: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids``.

    ``ids`` is binary, little-endian unsigned 32-bit.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", "size", before.alias("before"))  # one row per shard
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_fs(row["path"])
                start = row["before"]
                with fs.open_input_file(at) as file:
                    for doc_ids, nulls, counts, flat in read_shard(file, row["size"]):
                        offsets = np.concatenate([[0], np.cumsum(counts)])
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool)), pa.array(start + offsets[:-1], pa.int64()), pa.array(counts, pa.int64()), binary_array(flat, offsets)], names=out.names)
                        start += int(offsets[-1])

    return files.repartition(max(1, manifest.count())).mapInArrow(read, out)
