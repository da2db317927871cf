import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loamlog.llm import bpe, packing, token_files, tokens

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PARTS = list("abcABZ  \n\t'.,!-%&é́̈İß9٣²€日本  　\x1c\x85…") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'T", "n't ", "dogs'. ", "<|", "|>", "  ", " \n "]


def mixed(n):
    r = random.Random(3)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 50))) for _ in range(n)]


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_the_library():
    texts = [*mixed(3000), None, ""]
    flat, counts = tokens.WordEncoder(WORD).encode(pa.array(texts, pa.string()))
    tokenizer, at = Tokenizer.from_file(WORD), 0
    for t, n in zip(texts, counts, strict=True):
        assert flat[at : at + n].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
        at += n


def test_words_of_byte_bpe_equal_the_library():
    tokenizer, table = Tokenizer.from_file(BYTE), bpe.piece_table(BYTE)
    for t in mixed(3000):
        data = np.frombuffer(t.encode(), np.uint8)
        starts = bpe.word_starts(data, np.array([0])).tolist() if len(data) else []
        words = [bytes(data[a:b]).decode() for a, b in zip(starts, [*starts[1:], len(data)])]
        ids = [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids]
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids
        assert bpe.join_pieces(np.array(ids, int), np.array([len(ids)]), table)[0].decode("utf-8", "replace") == tokenizer.decode(ids, skip_special_tokens=False)


def by_piece(counts, capacity):
    """Best-fit decreasing piece by piece."""
    left, out = [], []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [(room, i) for i, room in enumerate(left) if room >= length]
        if fits:
            left[min(fits)[1]] -= length
        else:
            left.append(capacity - length)
    return sorted(left)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 16, 50])
    counts = {n: r.randint(1, 9) for n in r.sample(range(1, capacity + 1), min(capacity, 6))}
    plan = packing.plan_windows(counts, capacity)
    assert sorted(x for _, n, used in plan.ranges.tolist() for x in [capacity - used] * n) == by_piece(counts, capacity)
    assert sum(plan.runs[:, 2]) == sum(counts.values())


def test_tightest_window():
    tree = packing.CapacityTree(100)
    assert tree.tightest(1) is None
    for c in (5, 40, 41, 100):
        tree.put(c, True)
    assert [tree.tightest(n) for n in (1, 6, 41, 42)] == [5, 40, 41, 100]
    tree.put(41, False)
    assert tree.tightest(41) == 100


def test_pack_documents(spark, documents, texts):
    rows = packing.pack_documents(documents(texts), WORD, capacity=256).collect()
    ids = {i: np.array([*ids_of(WORD, t), 1], "<u4") for i, t in enumerate(texts)}
    seen, sequences = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault((r.sequence_id, r.sequence_used, r.sequence_length), []).append((r.offset, r.length))
    for i, own in ids.items():
        assert [s for s, _ in sorted(seen[i])] == list(np.cumsum([0, *(n for _, n in sorted(seen[i]))])[:-1]) and sum(n for _, n in seen[i]) == len(own)
    for (_, used, padded), pieces in sequences.items():
        assert [o for o, _ in sorted(pieces)] == list(np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1])
        assert sum(n for _, n in pieces) == used <= 256 and padded == (256 if used & (used - 1) else used)
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 256) + 2


def test_packed_sequences_hold_the_ids(spark, documents, texts):
    pieces = tokens.token_pieces(documents(texts), WORD, 128, 1)
    placed = packing.pack(pieces, 128)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length].tobytes() == bytes(r.ids)


def test_empty_tables(spark, documents):
    empty = documents([]).limit(0)
    assert packing.pack_documents(empty, WORD).count() == 0
    assert bpe.encode_and_decode(empty, BYTE).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(empty, WORD)).count() == 0


def test_repeated_rows_and_null_ids(spark, documents):
    docs = documents({3: "a b c"}).unionByName(documents({3: "a b c"})).unionByName(documents({}).limit(0))
    docs = docs.unionByName(docs.selectExpr("cast(null as long) as doc_id", *docs.columns[1:]))
    assert packing.pack_documents(docs, WORD).count() == 4
    assert bpe.encode_and_decode(docs, BYTE).where("n_tokens = 3").count() == 4
    rows = token_files.read_token_files(token_files.write_token_files(docs, WORD)).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in rows] == [(None, 0), (None, 4), (3, 8), (3, 12)]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_blocks_round_trip(n):
    r = np.random.default_rng(n)
    for high in (1, 2, 50_000, 2**32):
        ids = r.integers(0, high, n).astype(np.uint32)
        if n > 20:
            ids[r.integers(0, n, n // 20)] = 2**32 - 1
        blocks = token_files.encode_blocks(ids)
        starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
        assert np.array_equal(token_files.decode_blocks(b"".join(blocks), starts), ids)
        assert all(len(b) < 4 * token_files.BLOCK + 400 for b in blocks)


def test_outliers_are_exceptions_not_width():
    ids = np.arange(512, dtype=np.uint32) % 16
    plain = len(token_files.encode_blocks(ids)[0])
    ids[7] = 4_000_000_000
    assert len(token_files.encode_blocks(ids)[0]) == plain + 6


def test_token_files(spark, documents, texts):
    docs = documents({100 - i: t for i, t in enumerate(texts)})
    rows = token_files.read_token_files(token_files.write_token_files(docs.repartition(3), WORD)).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        own = np.array([*ids_of(WORD, texts[100 - r.doc_id]), 2], "<u4")
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(own), own.tobytes())
        at += len(own)
    assert len(rows) == len(texts)


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_encode_and_decode(spark, documents, texts, block_bytes):
    tokenizer = Tokenizer.from_file(BYTE)
    rows = bpe.encode_and_decode(documents(texts).repartition(2), BYTE, block_bytes=block_bytes).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        own = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_text) == (len(own), ",".join(map(str, own)))
        assert r.decoded == tokenizer.decode(own, skip_special_tokens=False)


def test_columns_that_are_called_as_new_ones_are_replaced(spark):
    rows = spark.createDataFrame([(1, 0, 5, "x", "y", 1), (2, 0, 3, "x", "y", 2)], "doc_id long, start long, length long, sequence_id string, offset string, other int")
    got = packing.pack(rows, 8).collect()
    assert sorted((r.doc_id, r.other, r.sequence_id, r.offset) for r in got) == [(1, 1, 0, 0), (2, 2, 0, 5)]
