"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, byte_slices, checkpointed, components, discard, shuffle_partitions, stored

WORDS = 5
BANDS, ROWS = 24, 4  # a pair of similarity 0.8 shares no band with probability 3e-6, one of 0.85 with 2e-8
BITS = 4
TILE = 512
STAR = 64  # sets that meet a band's head at once
NO_POOL = -(1 << 62) - 1  # in the place of a component's id, for the small ones of a family together
SIEVE_WORDS = 1 << 18  # of 64 bits, for the ids whose texts are fetched
SCREEN_SIGMAS = 7.0  # misses a pair at the threshold with probability 3e-9 (0.85) or 1e-9 (0.8), less than the bands do

_random = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _random.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's word shingles in order of the text, repeats included, and their number for each text.

    A-Z are lowered; words are runs of characters other than space and U+0009 to U+000D. A text with fewer
    words has its whole sequence as the only shingle; one without words has none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(split)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = hashed[coded.indices.to_numpy(zero_copy_only=False)][real]
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[bounds])
    at = np.cumsum(counts) - counts
    number = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    start = np.repeat(at - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
    width = np.repeat(np.minimum(counts, words), number)
    out = np.repeat(np.minimum(counts, words).astype(np.uint64), number)
    for k in range(words):
        own = start + k if k == 0 else np.minimum(start + k, max(0, len(codes) - 1))
        value = out * BASE + codes[own] if len(codes) else out
        out = mix(value) if k == 0 else np.where(k < width, mix(value), out)
    return out, number


def distinct_sets(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Each text's hashes, sorted and without repeats."""
    out, at = [], 0
    for n in counts.tolist():
        own = np.sort(hashes[at : at + n])
        if n > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
        at += n
    return out


def minima(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minimum of each text's hashes under each of the linear permutations of 32 bits; texts must have a hash."""
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), BANDS * ROWS), np.uint32)
    work = np.empty_like(values)
    for k in range(BANDS * ROWS):
        np.multiply(values, FACTORS[k], out=work)
        np.add(work, SHIFTS[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band."""
    rows = found.reshape(len(found), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        key = mix(key * BASE + rows[:, :, r])
    return key.view(np.int64)


def low_bits(found: np.ndarray) -> np.ndarray:
    """The lowest ``BITS`` bits of the minima, packed to bytes."""
    mixed = mix(found.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    bits = (mixed[:, :, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(found), -1), axis=1, bitorder="little")


def _corrected(differ: np.ndarray) -> np.ndarray:
    """Similarities by the number of minima whose low bits differ, corrected for chance agreement."""
    chance = 2.0**-BITS
    return (1 - differ / (BANDS * ROWS) - chance) / (1 - chance)


def _differing(x: np.ndarray) -> np.ndarray:
    """How many minima differ, by the exclusive or of a word of two signatures."""
    some = x.copy()
    for k in range(1, BITS):
        some |= x >> np.uint64(k)
    return np.bitwise_count(some & np.uint64(sum(1 << i for i in range(0, 64, BITS))))


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of all pairs of packed signatures (rows of 64-bit words), corrected for chance agreement of low bits."""
    differ = np.zeros((len(a), len(b)), np.int32)
    for word in range(a.shape[1]):
        differ += _differing(a[:, word, None] ^ b[None, :, word])
    return _corrected(differ)


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As :func:`estimated`, of each row of ``a`` and the one of ``b`` at its place."""
    return _corrected(_differing(a ^ b).sum(axis=1, dtype=np.int64))


def screen(percent: int) -> float:
    """The estimate below which a pair is no link."""
    threshold = percent / 100
    return threshold - SCREEN_SIGMAS * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5


def possible(signatures: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of ``left`` and ``right`` items may be links: their estimate doesn't lie ``SCREEN_SIGMAS`` standard deviations below the threshold, and their sizes allow it."""
    low, high = np.minimum.outer(sizes[left], sizes[right]), np.maximum.outer(sizes[left], sizes[right])
    return (estimated(signatures[left], signatures[right]) >= screen(percent)) & (100 * low >= percent * high)


def link_sets(sets: list[np.ndarray], signatures: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right`` items.

    Pairs that can't be links (see :func:`possible`) are skipped, and so are those that already belong together, by ``groups`` or links found so far;
    every other pair is decided on its full sets.
    """
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    present = np.zeros(int(codes.max()) + 1, bool)
    root = np.arange(len(sets)) if groups is None else np.unique(groups, return_inverse=True)[1]
    links = []
    maybe = possible(signatures, sizes, left, right, percent)
    for k, i in enumerate(left):
        own = right[maybe[k]]
        own = own[(own != i) & (root[own] != root[i])]
        if not len(own):
            continue
        present[codes[starts[i] : starts[i] + sizes[i]]] = True
        lengths = sizes[own]
        ends = np.cumsum(lengths)
        picked = np.repeat(starts[own] - (ends - lengths), lengths) + np.arange(ends[-1])
        common = np.add.reduceat(present[codes[picked]].astype(np.int64), ends - lengths)
        present[codes[starts[i] : starts[i] + sizes[i]]] = False
        for j in own[100 * common >= percent * (sizes[i] + lengths - common)]:
            if root[i] != root[j]:
                links.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return links


def _signed(docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    rows = bound_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 3 << 20):
                hashes, counts = shingle_hashes(part["text"], words)
                sets = distinct_sets(hashes, counts)
                full = np.flatnonzero(counts)
                keys, bits = [None] * len(part), [None] * len(part)
                if len(full):
                    found = minima(hashes, counts[full])
                    for i, k, b in zip(full.tolist(), band_keys(found), low_bits(found), strict=True):
                        keys[i], bits[i] = k, b.tobytes()
                name = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(len, sets), pa.int64()), pa.array(name, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "bits"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, bits binary")


TILE_KEY = ("family", "low", "high")


def _tiles(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """Rows of each tile; they stand together."""
    held: list[dict] = []
    tile = None
    for batch in batches:
        for part in byte_slices(batch, column):
            for row in part.to_pylist():
                key = tuple(row[k] for k in TILE_KEY)
                if key != tile and held:
                    yield held
                    held = []
                tile = key
                held.append(row)
    if held:
        yield held


def _sides(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both sides of a tile (all on both, where it is of one block), and the packed bits."""
    side = np.array([r["side"] for r in rows])
    bits = np.frombuffer(b"".join(r["bits"] for r in rows), "<u8").reshape(len(rows), -1)
    if rows[0]["low"] == rows[0]["high"]:
        return np.arange(len(rows)), np.arange(len(rows)), bits
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), bits


def _dealt(tiles: DataFrame) -> DataFrame:
    return tiles.repartition(shuffle_partitions(tiles.sparkSession), *TILE_KEY).sortWithinPartitions(*TILE_KEY, "doc_id")


def _tile_links(tiles: DataFrame, words: int, percent: int) -> DataFrame:
    """Links within tiles (``family``, ``low``, ``high``, ``side``, ``doc_id``, ``component``, ``bits``, ``text``), of which each has a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches, "text"):
            left, right, bits = _sides(rows)
            if len(rows) < 2 or not len(left) or not len(right):
                continue
            sets = distinct_sets(*shingle_hashes(pa.array([r["text"] for r in rows], pa.string()), words))
            found = link_sets(sets, bits, left, right, percent, np.array([r["component"] for r in rows]))
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([rows[i]["doc_id"] for i, _ in found], pa.int64()), "b": pa.array([rows[j]["doc_id"] for _, j in found], pa.int64())})

    return _dealt(tiles).mapInArrow(run, "a long, b long")


def _open_rows(tiles: DataFrame, percent: int) -> DataFrame:
    """Rows of tiles (as in :func:`_tile_links`, with ``n`` and without texts) that another one of another component may be linked to, by signatures alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches, "bits"):
            left, right, bits = _sides(rows)
            sizes, component = (np.array([r[k] for r in rows]) for k in ("n", "component"))
            maybe = possible(bits, sizes, left, right, percent) & (component[left][:, None] != component[right][None, :])
            own = np.union1d(left[maybe.any(axis=1)], right[maybe.any(axis=0)])
            if len(own):
                yield pa.RecordBatch.from_pylist([{k: rows[i][k] for k in (*TILE_KEY, "side", "doc_id", "component", "bits")} for i in own.tolist()], schema=kinds)

    kinds = pa.schema([("family", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("side", pa.int32()), ("doc_id", pa.int64()), ("component", pa.int64()), ("bits", pa.binary())])
    return _dealt(tiles).mapInArrow(run, "family long, low int, high int, side int, doc_id long, component long, bits binary")


def _screened(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` that may be links, by their sizes and signatures ``n_a``, ``n_b``, ``bits_a``, ``bits_b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            sizes = [batch[k].to_numpy() for k in ("n_a", "n_b")]
            bits = [np.frombuffer(b"".join(batch[k].to_pylist()), "<u8").reshape(len(batch), -1) if len(batch) else None for k in ("bits_a", "bits_b")]
            if len(batch):
                keep = (similar(*bits) >= screen(percent)) & (100 * np.minimum(*sizes) >= percent * np.maximum(*sizes))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _sieved(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids`` and few others, so that a join need not move all of them.

    A text passes where a bit is set by the hash of its id. The bits have at most ``SIEVE_WORDS`` rows however many ids there are, and are broadcast. With many more ids than
    bits all texts pass; none that is needed is ever held back.
    """
    mark, bit = F.xxhash64("doc_id"), F.expr("cast(xxhash64(doc_id) & 63 as int)")
    word = F.pmod(F.shiftright(mark, 6), F.lit(SIEVE_WORDS)).alias("_word")
    sieve = ids.select(word, F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return texts.select("*", word).join(F.broadcast(sieve), "_word").where(F.getbit("_bits", bit) == 1).drop("_word", "_bits")


def _with_texts(rows: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of tiles with the text of each; ``ids`` has their doc_ids."""
    return _sieved(texts, ids).join(rows, "doc_id").select(*TILE_KEY, "side", "doc_id", "component", "bits", "text")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row.

    Documents are linked where ``100 * common >= percent * united`` shingles; ``component_id`` is the least doc_id
    that links reach and ``kept`` says that it is the own one. Documents without words have no shingles and no links.

    1. One pass takes each text's shingle set, its minima, the keys of its bands and the packed low bits.
       Rows with equal sets become one.
    2. Sets that share a band are paired with the band's least id only. Pairs that pass the bits' collision-corrected estimate are decided on full sets, a head
       with about ``STAR`` of its sets at a time. Pairs of a bucket are never listed.
    3. Components of all pairs of step 2, passed or not, are families of candidates: no set outside has a band in common. Families that step 2 has linked as a whole are
       done. The sets of others are dealt into blocks of about ``TILE`` and each pair of blocks is a tile, which bounds every task however large a family is; tiles within one linked
       component are left out. Tiles are screened by signatures alone, and only sets that may have a link to another component fetch their texts: these are
       decided on full sets. A tile returns at most as many links as it has rows.
    4. Components of the links of both steps are the result.

    Pairs that share no band (see ``BANDS``) are missed with the probability given there. Null texts are empty. Rows with a null
    doc_id link with nothing and are kept. Repeated rows stay and get equal values. An empty table gives no rows. Other columns are not read.
    """
    signed = stored(_signed(docs, id_column, text_column, words), "signatures")
    named = signed.where("set_key is not null and doc_id is not null")
    sets = named.groupBy("set_key").agg(F.min_by(F.struct("bands", "bits", "n_shingles"), "doc_id").alias("s"), F.min("doc_id").alias("doc_id"))
    sets = stored(sets.select("set_key", "doc_id", "s.bands", "s.bits", F.col("s.n_shingles").alias("n")), "sets")
    marks = sets.select("doc_id", "bits", "n")
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    keys = sets.select("doc_id", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = checkpointed(keys.join(heads, "key").where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
    joints = checkpointed(met.distinct())

    # step 2: every set against the heads of its bands
    of_a = checkpointed(joints.join(marks.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits_a"), F.col("n").alias("n_a")), "a"))
    of_b = of_a.join(marks.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits_b"), F.col("n").alias("n_b")), "b")
    pairs = checkpointed(_screened(of_b.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), percent))
    crowd = pairs.groupBy(F.col("b").alias("head")).agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    beside = pairs.withColumnRenamed("b", "head").join(crowd, "head").select(F.col("head").alias("family"), block.alias("low"), F.lit(1).alias("side"), F.col("a").alias("doc_id"))
    own = crowd.select(F.col("head").alias("family"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("low"), F.lit(0).alias("side"), F.col("head").alias("doc_id"))
    star = checkpointed(beside.unionByName(own))
    rows = star.select("family", "low", F.lit(-1).alias("high"), "side", "doc_id", F.col("doc_id").alias("component"))
    first = stored(_tile_links(_with_texts(rows.join(marks.drop("n"), "doc_id"), texts, star), words, percent), "head_links")
    linked = components(first)

    # step 3: what is left between components of a family
    families = checkpointed(components(joints).withColumnRenamed("component", "family").join(linked, "node", "left").select(F.col("node").alias("doc_id"), "family", F.coalesce("component", "node").alias("component")))
    open_ = families.groupBy("family").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("family")
    members = families.join(open_, "family")
    kinds = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("size"))
    # a component that fills blocks has its own, the small ones of a family share some; a block's number is its place among the family's
    kinds = kinds.withColumn("pool", F.when(F.col("size") >= TILE, F.col("component")).otherwise(F.lit(NO_POOL)))
    pools = kinds.groupBy("family", "pool").agg(F.ceil(F.sum("size") / F.lit(TILE)).cast("int").alias("blocks"))
    pools = checkpointed(pools.withColumn("from", F.coalesce(F.sum("blocks").over(Window.partitionBy("family").orderBy("pool").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")))  # a row for TILE members at least, but for the shared pool
    placed = members.join(kinds.drop("size"), ["family", "component"]).join(pools, ["family", "pool"])
    placed = checkpointed(placed.select("family", "doc_id", "component", "pool", (F.col("from") + F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).cast("int").alias("block")))
    blocks = pools.select("family", "pool", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("blocks") - 1)).alias("block"))
    other = blocks.select("family", F.col("pool").alias("pool2"), F.col("block").alias("block2"))
    tiles = checkpointed(blocks.join(other, "family").where((F.col("block") <= F.col("block2")) & ((F.col("pool") != F.col("pool2")) | (F.col("pool") == NO_POOL))).select("family", F.col("block").alias("low"), F.col("block2").alias("high")))
    sides = tiles.select("family", "low", "high", F.col("low").alias("block"), F.lit(0).alias("side")).unionByName(tiles.where("low <> high").select("family", "low", "high", F.col("high").alias("block"), F.lit(1).alias("side")))
    cast = checkpointed(placed.join(sides, ["family", "block"]).join(marks, "doc_id").select(*TILE_KEY, "side", "doc_id", "component", "bits", "n"))
    rest = checkpointed(_open_rows(cast, percent))
    second = stored(_tile_links(_with_texts(rest, texts, rest), words, percent), "tile_links")
    links = linked if second.isEmpty() else components(first.unionByName(second))
    discard(met, joints, of_a, pairs, star, first, families, pools, placed, tiles, cast, rest, second)
    roots = sets.select("set_key", "doc_id").join(links.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key")
    lone = out.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = out.where("set_key is not null and doc_id is not null").join(roots, "set_key").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return joined.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
