"""Byte-level BPE by a table of distinct words."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, byte_slices, kept_in_worker, open_fs, ragged_take, shared_path, shuffle_partitions, stored

BLOCK_BYTES = 24 << 20
ENCODE = 20_000
BUCKET_BYTES = 256 << 20  # of texts for a bucket of the distinct-word table, at most
TABLE_BYTES, WORD_BYTES = 96 << 20, 200  # of a bucket's words that a task knows, and of a word besides its letters; beyond it they are forgotten and met again
CODEC = pa.Codec("zstd", 3)


def _tokenizer(path: str):
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        return found

    return kept_in_worker(("tokenizer", path), make)


def word_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where words of the texts that start at ``texts`` begin: a word is white space and what follows up to the next white space.

    The tokenizer's pieces never go on from other characters to white space, so ids of words are those of the text. Only ASCII white space
    starts a word, and not after other white space, which belongs to the same run.
    """
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    stop = space.copy()
    stop[28:32] = True
    at = np.flatnonzero(space[data])
    at = at[at > 0]
    at = at[~stop[data[at - 1]]]
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) & (one >= 0x80) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    wide |= (three == 0xE2) & (two == 0x81) & (one == 0x9F) | (three == 0xE3) & (two == 0x80) & (one == 0x80) | (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    return np.union1d(at[~wide], texts)


class BlockWriter:
    """Gathers texts of a block as positions in its list of distinct words."""

    def __init__(self):
        self.slots: dict[str, int] = {}
        self.keys, self.counts, self.index, self.size = [], [], [], 0

    def add(self, keys: pa.Array, texts: pa.Array) -> None:
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        full = offsets[:-1][np.diff(offsets) > 0]
        starts = word_starts(data, full) if len(full) else np.empty(0, np.int64)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        listed = coded.dictionary.to_pylist()
        slots = self.slots
        place = np.fromiter((slots.setdefault(w, len(slots)) for w in listed), np.int32, len(listed))
        self.index.append(place[coded.indices.to_numpy(zero_copy_only=False)])
        self.counts.append(np.diff(np.searchsorted(starts, offsets)))
        self.keys.append(keys)
        self.size += len(data)

    def close(self, path: str, buckets: int) -> list[tuple[int, bytes]]:
        """Write the positions; returns the words of each bucket of the distinct-word table, packed.

        Positions count words from the most frequent on, which packs well. The file also has each one's place
        in the order of buckets, in which ids come back.
        """
        index = np.concatenate(self.index)
        order = np.argsort(-np.bincount(index, minlength=len(self.slots)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        words = pa.array(self.slots, pa.string())
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in self.slots), np.int64, len(self.slots))
        sorted_ = pc.sort_indices(words).to_numpy().astype(np.int64)
        sorted_ = sorted_[np.argsort(bucket[sorted_], kind="stable")]
        place = np.empty(len(order), np.int32)
        place[rank[sorted_]] = np.arange(len(order), dtype=np.int32)
        table = pa.RecordBatch.from_arrays([pa.concat_arrays(self.keys), pa.array(np.concatenate(self.counts), pa.int32())], names=["doc_id", "words"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_batch(table)
        parts = [sink.getvalue().to_pybytes(), pack_numbers(place), pack_numbers(rank[index])]
        fs, at = open_fs(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(at, compression=None) as out:
            out.write(np.array([len(p) for p in parts], "<u8").tobytes())
            for p in parts:
                out.write(p)
        if not len(order):
            return [(0, pack_words(words))]  # only empty texts: a row without words still names the block
        listed = words.take(pa.array(sorted_))
        ends = np.searchsorted(bucket[sorted_], np.arange(buckets + 1))
        return [(b, pack_words(listed.slice(int(x), int(y - x)))) for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if y > x]


def _squeeze(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + (CODEC.compress(data, asbytes=True) if data else b"")


def _expand(data: bytes) -> bytes:
    size = struct.unpack_from("<Q", data)[0]
    return CODEC.decompress(data[8:], decompressed_size=size, asbytes=True) if size else b""


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers by planes of bytes, whose high ones are nearly all zero."""
    return _squeeze(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _two(first: bytes, second: bytes) -> bytes:
    return struct.pack("<Q", len(first)) + first + second


def _both(data: bytes) -> tuple[bytes, bytes]:
    size = struct.unpack_from("<Q", data)[0]
    return data[8 : 8 + size], data[8 + size :]


def pack_words(words: pa.Array) -> bytes:
    return _two(pack_numbers(pc.binary_length(words).to_numpy(zero_copy_only=False)), _squeeze(b"".join(words.cast(pa.binary()).to_pylist())))


def unpack_words(data: bytes) -> list[str]:
    sizes, text = _both(data)
    sizes, text = unpack_numbers(sizes), _expand(text)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).to_pylist()


def read_block(path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids of a block's texts, their numbers of words, and each word's place in the order of buckets."""
    fs, at = open_fs(path)
    with fs.open_input_file(at) as file:
        sizes = np.frombuffer(file.read(24), "<u8").astype(int)
        head, place, index = (file.read(int(n)) for n in sizes)
    table = pa.ipc.open_stream(head).read_all().combine_chunks()
    return table["doc_id"].combine_chunks(), table["words"].to_numpy(), unpack_numbers(place)[unpack_numbers(index)]


def bucket_count(docs: DataFrame, text_column: str = "text") -> int:
    """Buckets of the distinct-word table: one for ``BUCKET_BYTES`` of texts, and as many as there are shuffle partitions at least."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")).cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def split_words(docs: DataFrame, base: str, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """Split texts to words: rows ``bucket``, ``block``, ``words``, the distinct words of a block that fall into a bucket of the table.

    A block is up to ``block_bytes`` of a task's texts; a longer text is one of its own. Its file below ``base`` has what is left: each text's words as positions in the block's list.
    An attempt writes files of its own, which only its own rows name.
    """
    buckets = buckets or bucket_count(docs, text_column)
    rows = bound_batches(docs).select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = BlockWriter()

        def close() -> Iterator[pa.RecordBatch]:
            name = uuid.uuid4().int >> 65
            found = block.close(block_path(base, name), buckets)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([name] * len(found), pa.int64()), pa.array([w for _, w in found], pa.binary())], names=["bucket", "block", "words"])

        for batch in batches:
            for part in byte_slices(batch, "text"):
                if block.size and block.size + part["text"].nbytes > block_bytes:
                    yield from close()
                    block = BlockWriter()
                block.add(part["doc_id"], part["text"])
        if block.keys:
            yield from close()

    return rows.mapInArrow(run, "bucket int, block long, words binary")


def block_path(base: str, name: int) -> str:
    return f"{base}/{name:016x}.words"


def encode_words(words: DataFrame, tokenizer_path: str, buckets: int | None = None) -> DataFrame:
    """Ids for the words of each row of :func:`split_words`: ``block``, ``bucket``, ``ids`` (packed).

    A bucket of the distinct-word table is built by one task: equal words of all blocks meet there and each is encoded once, or again after ``TABLE_BYTES`` of others. Buckets are
    by a hash of the word and as many as the texts need, and a word comes once a block however frequent it is, so no bucket is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        bucket, slots, flats, lengths, size = None, {}, [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket or size > TABLE_BYTES:
                    bucket, slots, flats, lengths, size = row["bucket"], {}, [], [], 0
                listed = unpack_words(row["words"])
                todo = [w for w in listed if w not in slots]
                size += sum(map(len, todo)) + WORD_BYTES * len(todo)
                for k in range(0, len(todo), ENCODE):
                    found = [e.ids for e in tokenizer.encode_batch_fast(todo[k : k + ENCODE], add_special_tokens=False)]
                    lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
                    flats.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
                slots.update(zip(todo, range(len(slots), len(slots) + len(todo)), strict=True))
                flats, lengths = [np.concatenate([*flats, np.empty(0, np.uint32)])], [np.concatenate([*lengths, np.empty(0, np.int64)])]
                starts = np.cumsum(lengths[0]) - lengths[0]
                place = np.fromiter(map(slots.__getitem__, listed), np.int64, len(listed))
                ids = ragged_take(flats[0], starts[place], lengths[0][place])
                packed = _two(pack_numbers(lengths[0][place]), pack_numbers(ids))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["bucket"]], pa.int32()), pa.array([packed], pa.binary())], names=["block", "bucket", "ids"])

    dealt = words.repartition(buckets or shuffle_partitions(words.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, bucket int, ids binary")


def piece_table(tokenizer_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every id one after another, and where each starts; ids without a piece have none.

    A special token stands for its text. The size is that of the vocabulary.
    """
    tokenizer = _tokenizer(tokenizer_path)
    # Fixed: byte-level BPE writes a printable Latin-1 byte as itself and the others, ascending, as U+0100 and on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    pieces = []
    for i in range(tokenizer.get_vocab_size()):
        piece = tokenizer.id_to_token(i) or ""
        plain = i not in special and all(c in byte_of for c in piece)
        pieces.append(bytes(byte_of[c] for c in piece) if plain else special.get(i, piece).encode())
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


def join_pieces(ids: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """For each text the pieces of its ids, one after another."""
    data, starts = table
    size = starts[ids + 1] - starts[ids]
    flat = ragged_take(data, starts[ids], size)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    whole = flat.tobytes()
    return [whole[a:e] for a, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decimal_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`piece_table`: each id as a decimal number and a comma."""
    pieces = [f"{i},".encode() for i in range(size)]
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


ENCODED = (T.StructField("n_tokens", T.LongType()), T.StructField("ids_text", T.StringType()), T.StructField("decoded", T.StringType()))


def encode_and_decode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_text`` (decimal ids joined by commas) and ``decoded`` (their text) of each row.

    Ids are those of the tokenizer without added special tokens; special tokens' texts are theirs. Decoding joins each id with its piece; that table is bounded by the vocabulary and dense by id, so
    each task has it and the join is a look-up by place. Invalid bytes are replaced. Null and empty texts have no ids, repeated rows stay, an empty table gives no rows; other columns are not read.
    """
    kind = docs.select(F.col(id_column).alias("doc_id")).schema["doc_id"]
    base = shared_path(docs.sparkSession, "words")
    # a table, so that only committed rows name blocks: a task that runs again would make new ones
    buckets = bucket_count(docs, text_column)
    words = stored(split_words(docs, base, id_column, text_column, block_bytes, buckets), "split")
    joined = encode_words(words, tokenizer_path, buckets)

    def texts(name: int, parts: list[bytes], tables: tuple) -> Iterator[pa.RecordBatch]:
        keys, words, index = read_block(block_path(base, name))
        pairs = [tuple(map(unpack_numbers, _both(p))) for p in parts]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([n for n, _ in pairs]).astype(np.int64))])
        flat = np.concatenate([i for _, i in pairs]).astype(np.int64)
        ends = np.cumsum(words)
        at = 0
        while at < len(keys):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + (1 << 19), side="right")))
            own = index[before : int(ends[to - 1])]
            sizes = offsets[own + 1] - offsets[own]
            found = ragged_take(flat, offsets[own], sizes)
            counts = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(words[at:to])])])
            numbers = [x[:-1].decode() for x in join_pieces(found, counts, tables[1])]
            decoded = [x.decode("utf-8", "replace") for x in join_pieces(found, counts, tables[0])]
            yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.array(counts, pa.int64()), pa.array(numbers, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", *(f.name for f in ENCODED)])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(tokenizer_path)
        tables = (pieces, decimal_table(len(pieces[1])))
        block, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block and parts:
                    yield from texts(block, parts, tables)
                    parts = []
                block = row["block"]
                parts.append(row["ids"])
        if parts:
            yield from texts(block, parts, tables)

    dealt = joined.repartition(shuffle_partitions(docs.sparkSession), "block").sortWithinPartitions("block", "bucket")
    return dealt.mapInArrow(run, T.StructType([kind, *ENCODED]))
