"""Exact token ids with each distinct word encoded once."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_array, bound_batches, byte_slices, kept_in_worker, ragged_take

CACHE_BYTES = 24 << 20  # of words that an encoder knows
WORD_BYTES = 170  # of a word besides its letters: its string, its place in the dictionary, its ids
JOINED = 200
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Encodes texts of a tokenizer that lower-cases, drops white space and never looks across it.

    Texts are split at ASCII white space only, a subset of what the tokenizer itself splits
    at, so other white space stays inside a word and the tokenizer treats it there. A word's
    trailing ASCII punctuation (but for the apostrophe, which can belong to letters) is a word of its own
    where a letter or number stands before it, as the tokenizer separates them too. ASCII capitals
    are lowered. Words with the opening of a special token are left as they are. Ids of
    words are kept until they take ``CACHE_BYTES``, then forgotten, so memory stays bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ends = [i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.size = 0
        self.flat = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def _add(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        base = len(self.lengths)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])
        self.size += sum(map(len, words)) + WORD_BYTES * len(words)
        self.slots.update(zip(words, range(base, base + len(words)), strict=True))

    def _learn(self, words: list[str]) -> None:
        plain = pc.match_substring_regex(pa.array(words, pa.string()), r"^\pL+$").to_numpy(zero_copy_only=False)
        alone = [w for w, p in zip(words, plain, strict=True) if not p]
        words = [w for w, p in zip(words, plain, strict=True) if p]
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        known, parts, sizes = [], [], []
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids])
            if len(ends) == len(group):  # letters make one piece, and its last id alone ends a word
                known += group
                parts.append(ids)
                sizes.append(np.diff(ends, prepend=-1))
            else:
                alone += group
        if known:
            self._add(known, np.concatenate(parts), np.concatenate(sizes))
        if alone:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self._add(alone, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)

    def _slots_of(self, *columns: pa.Array) -> list[np.ndarray]:
        """Place of each word of the columns; new ones are learnt."""
        listed = [c.to_pylist() for c in columns]
        found = [np.fromiter(map(self.slots.get, words, repeat(-1)), np.int64, len(words)) for words in listed]
        missing = [np.flatnonzero(f < 0).tolist() for f in found]
        if new := list(dict.fromkeys(words[i] for words, at in zip(listed, missing, strict=True) for i in at)):
            self._learn(new)
            for words, at, slots in zip(listed, missing, found, strict=True):
                slots[at] = [self.slots[words[i]] for i in at]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's number of ids; null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = pc.list_flatten(split).dictionary_encode()
        words = coded.dictionary
        lowered = pc.ascii_lower(words)
        stem = pc.utf8_rtrim(lowered, characters=PUNCTUATION)
        cut = pc.and_(pc.match_substring_regex(stem, r"[\pL\pN]$"), pc.invert(pc.match_substring_regex(words, r"<\||\x{130}|\pM")))  # U+0130 lowers to a letter and a mark; marks may combine with a small letter only
        stem = pc.if_else(cut, stem, words)
        size = pc.binary_length(stem).to_numpy(zero_copy_only=False)
        tail = _tails(lowered, np.where(cut.to_numpy(zero_copy_only=False), size, -1))
        stems, tails = stem.dictionary_encode(), tail.dictionary_encode()
        if self.size > CACHE_BYTES:
            self._forget()
        slots = self._slots_of(stems.dictionary, tails.dictionary)
        pair = np.empty(2 * len(words), np.int64)
        pair[0::2] = slots[0][stems.indices.to_numpy(zero_copy_only=False)]
        pair[1::2] = slots[1][tails.indices.to_numpy(zero_copy_only=False)]
        table = ragged_take(self.flat, self.starts[pair], self.lengths[pair])
        sizes = self.lengths[pair].reshape(-1, 2).sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[word]
        flat = ragged_take(table, starts[word], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
        return flat, np.diff(ends[bounds])


def _tails(words: pa.Array, cut: np.ndarray) -> pa.Array:
    """What follows the first ``cut`` bytes of each word; empty where ``cut`` is negative."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    lengths = np.where(cut < 0, 0, np.diff(offsets) - cut)
    out = ragged_take(data, offsets[:-1] + np.maximum(cut, 0), lengths)
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(out)])


def word_encoder(path: str) -> WordEncoder:
    """One encoder a process; tasks of a stage that run one after another share its words."""
    return kept_in_worker(("words", path), lambda: WordEncoder(path))


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    if end_id is None:
        return flat, counts
    total = counts + 1
    out = np.full(int(total.sum()), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(total) - 1] = False
    out[keep] = flat
    return out, total


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int | None = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode texts and cut the ids of each into windows of at most ``window`` ids.

    Rows: ``doc_id``, ``start`` (ids of the text before the piece), ``length``, ``doc_tokens``
    and ``ids`` (little-endian unsigned 32-bit). Null or empty texts have the end id alone;
    without an end id they have no piece. Other columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                flat, counts = with_end(*encoder.encode(part["text"]), end_id)
                pieces = -(-counts // window)
                doc = np.repeat(np.arange(len(counts)), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * window
                length = np.minimum(window, counts[doc] - start)
                offsets = np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(counts[doc], pa.int64()), binary_array(flat.astype("<u4"), offsets)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    rows = bound_batches(docs).select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    out = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, out)
