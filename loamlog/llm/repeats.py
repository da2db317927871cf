"""Exact removal of repeated byte strings by suffix arrays of anchored contexts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, bound_batches, bucketed, byte_slices, discard, ragged_take, release_memory, shuffle_partitions, stored
from .induced import DEPTH, MEMORY, cool, mapped, sorted_suffixes

LENGTH = 200
GRAM = 100
SLICE = 128 << 10  # arrays of a slice stay in the cache
HOT = 1 << 18  # bytes of different contexts of one anchor, at most; more are split
POSITION_BITS = 24

_random = np.random.Generator(np.random.PCG64(271828))
_TABLES = _random.integers(0, 1 << 64, (2, 256), np.uint64)
_BASES = [int(x) | 1 for x in _random.integers(1 << 62, 1 << 63, 2, np.uint64)]
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(which: int, sign: int, n: int) -> np.ndarray:
    """Powers of a base, or of its inverse modulo 2**64."""
    found = _powers.get((which, sign))
    if found is None or len(found) < n:
        base = pow(_BASES[which], sign, 1 << 64)
        found = np.full(max(n, 1 << 18), base, np.uint64)
        found[0] = 1
        _powers[which, sign] = found = np.multiply.accumulate(found)
    return found[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Prefixes:
    """Polynomial hashes of any part of a byte array, from sums over its prefixes."""

    def __init__(self, data: np.ndarray, which: int):
        self.which = which
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * _power(which, 1, len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _power(self.which, -1, len(self.sums))[start]

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:-size]) * _power(self.which, -1, n)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, names_only: bool = False) -> dict[str, np.ndarray]:
    """Contexts of the texts ``data[offsets[i]:offsets[i+1]]``.

    Each window of ``length`` bytes has as its anchor the ``gram`` bytes within it that hash least, the leftmost at ties; that depends
    on its bytes alone, so equal windows have equal anchors at equal places. The windows of one anchor follow each other and
    are one context: ``text``, ``low`` (first window's start), ``windows``, ``anchor`` (hash of the anchor's bytes), ``place`` (of the anchor in the context), ``context`` (hash of all its bytes and the
    anchor's place). With ``names_only`` there are only the anchors' hashes.
    """
    sizes = np.diff(offsets)
    count = np.maximum(0, sizes - length + 1)
    if not count.sum():
        return {k: np.empty(0, np.int64) for k in ("text", "low", "windows", "anchor", "place", "context")}
    one = Prefixes(data, 0)
    hashed = _mix(one.grams(gram))
    low_bits = np.uint64((1 << POSITION_BITS) - 1)
    key = (hashed & ~low_bits) | np.arange(len(hashed), dtype=np.uint64)
    least = sliding_min(key, length - gram + 1)
    text = np.repeat(np.arange(len(sizes)), count)
    start = np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(len(text))
    at = (least[start] & low_bits).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    low, anchor = start[first], at[first]
    if names_only:
        return {"anchor": hashed[anchor].view(np.int64)}
    two = Prefixes(data, 1)
    windows = np.diff(np.append(first, len(at)))
    end = low + windows - 1 + length
    context = _mix(one.of(low, end)) ^ _mix(two.of(low, end) + ((anchor - low) * 1_000_003 + windows).astype(np.uint64))
    return {"text": text[first], "low": low - offsets[text[first]], "windows": windows, "anchor": hashed[anchor].view(np.int64), "place": anchor - low, "context": context.view(np.int64)}


CONTEXT = {"anchor": pa.int64(), "context": pa.int64(), "row_key": pa.int64(), "low": pa.int64(), "windows": pa.int32(), "place": pa.int32()}


def _contexts(texts: DataFrame, length: int, gram: int, names_only: bool = False) -> DataFrame:
    """Contexts of rows ``row_key``, ``text`` (binary), see :func:`anchors`."""
    most = 1 << (POSITION_BITS - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                keys = part["row_key"].to_numpy()
                buffers = part["text"].buffers()
                offsets = np.frombuffer(buffers[1], np.int32)[part["text"].offset : part["text"].offset + len(part) + 1].astype(np.int64)
                data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                pieces = [(0, data, offsets, keys)] if len(data) <= most + SLICE else [(b, data[a + b : min(e, a + b + most + length - 1)], np.array([0, min(e - a - b, most + length - 1)]), keys[i : i + 1]) for i, (a, e) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)) for b in range(0, max(1, int(e - a)), most)]
                for shift, own, bounds, names in pieces:
                    found = anchors(own, bounds, length, gram, names_only)
                    if not names_only:
                        found |= {"row_key": names[found["text"].astype(np.int64)], "low": found["low"] + shift}
                    yield pa.RecordBatch.from_pydict({k: pa.array(found[k], CONTEXT[k]) for k in columns})

    columns = ["anchor"] if names_only else list(CONTEXT)
    kinds = {pa.int64(): "long", pa.int32(): "int"}
    return texts.mapInArrow(run, ", ".join(f"{k} {kinds[CONTEXT[k]]}" for k in columns))


def narrowed(rows: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """Spans that are settled, and contexts that only their suffixes can settle, cut to the windows that may repeat.

    ``rows`` has all contexts of some anchors (``anchor``, ``place``, ``windows``, ``low``, ``row_key``, ``copies``), and ``data[offsets[i]:offsets[i+1]]`` their bytes.
    A window has half of what ``length`` leaves beside its anchor on the left of it, or on the right. So it can only repeat if another context
    of the anchor has the same bytes there. Contexts that are equal once they are cut repeat as a whole, and one stands for all of them.
    Returns the spans, the contexts and these contexts' bytes.
    """
    half = (length - gram) // 2
    anchor, place, windows = rows["anchor"], rows["place"], rows["windows"]
    start, size = offsets[:-1], np.diff(offsets)

    def shared(there: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = np.flatnonzero(there)
        keys = np.empty((len(own), 8 + half), np.uint8)
        keys[:, :8] = anchor[own].view(np.uint8).reshape(-1, 8)
        keys[:, 8:] = data[at[own][:, None] + np.arange(half)]
        codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 + half), len(own), [None, pa.py_buffer(keys)]).dictionary_encode().indices.to_numpy()
        out = np.zeros(len(there), bool)
        out[own] = np.bincount(codes, minlength=1)[codes] > 1
        return out

    left = shared(place >= half, start + place - half)
    right = shared(place + gram + half <= size, start + place + gram)
    first = np.where(left, 0, np.maximum(0, place - half + 1))
    last = np.where(right, windows, np.minimum(windows, place - (length - gram - half)))
    kept = np.flatnonzero(first < last)
    rows = {k: v[kept] for k, v in rows.items()}
    first, last, start = first[kept], last[kept], start[kept]
    rows |= {"low": rows["low"] + first, "windows": last - first, "place": rows["place"] - first}
    size = rows["windows"] - 1 + length
    data = ragged_take(data, start + first, size)
    offsets = np.concatenate([[0], np.cumsum(size)])
    content = binary_array(data, offsets).dictionary_encode().indices.to_numpy()
    order = np.lexsort((content, rows["place"], rows["anchor"]))
    fresh = np.concatenate([[True], np.any([np.diff(x[order]) != 0 for x in (content, rows["place"], rows["anchor"])], axis=0)])[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    copies = np.bincount(group, minlength=1)
    spans = {k: rows[k][(copies[group] > 1) & (rows["copies"] == 1)] for k in ("row_key", "low", "windows")}
    one = order[np.flatnonzero(fresh)]  # a group's first
    rows["copies"][one] = np.where(copies[group[one]] > 1, 2, rows["copies"][one])
    _, kind, members = np.unique(rows["anchor"][one], return_inverse=True, return_counts=True)
    one = np.sort(one[members[kind] > 1])
    return spans, {k: v[one] for k, v in rows.items()}, ragged_take(data, offsets[one], size[one])


class Shard:
    """Contexts of a task, on disk; :meth:`repeated` sorts the suffixes of all of them.

    The text has each context's bytes plus 2, then 1, and ends with 0. Only a window has ``length`` characters up to the end of its context.
    """

    META = np.dtype([("row_key", "<i8"), ("low", "<i8"), ("start", "<i8"), ("windows", "<i4"), ("alone", "?")])

    def __init__(self, length: int, memory: int = MEMORY):
        self.length, self.memory = length, memory
        self.text, self.meta = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        self.size = self.count = 0

    def add(self, rows: dict[str, np.ndarray], data: np.ndarray) -> None:
        size = rows["windows"].astype(np.int64) - 1 + self.length
        ends = np.cumsum(size + 1)
        text = np.empty(int(ends[-1]) if len(ends) else 0, np.uint16)
        text[ends - 1] = 1
        inner = np.ones(len(text), bool)
        inner[ends - 1] = False
        text[inner] = data.astype(np.uint16) + 2
        meta = np.zeros(len(size), self.META)
        for k in ("row_key", "low", "windows"):
            meta[k] = rows[k]
        meta["start"] = self.size + ends - size - 1
        meta["alone"] = rows["copies"] == 1
        self.text.write(text)
        self.meta.write(meta)
        self.size += len(text)
        self.count += len(meta)

    def repeated(self) -> Iterator[dict[str, np.ndarray]]:
        """Spans of windows that occur at another place of these contexts too: two are equal if their suffixes stand next to each other with a common prefix of ``length``."""
        if not self.count:
            return
        depth = max(DEPTH, self.length)
        text = mapped(self.size + 1 + depth + 8, np.uint16, self.text)
        again = mapped(self.size + 1, bool)
        before = np.empty(0, np.int64)
        for at, lcp in sorted_suffixes(text, 258, self.memory, depth, self.size + 1):
            joined = np.concatenate([before, at])
            near = np.flatnonzero(lcp >= self.length)
            again[at[near]] = True
            again[joined[near + len(before) - 1]] = True  # the very first suffix has no common prefix
            before = at[-1:]
        cool(text, again)
        meta = mapped(self.count, self.META, self.meta)
        for k in range(0, self.count, 1 << 14):
            own = meta[k : k + (1 << 14)]
            start, windows = own["start"], own["windows"].astype(np.int64)
            low = int(start[0])
            edges = np.zeros(int(start[-1] + windows[-1]) - low + 2, np.int8)
            edges[start - low] = 1
            edges[start - low + windows] = -1
            flags = np.cumsum(edges, dtype=np.int8)[:-1].astype(bool)
            flags &= again[low : low + len(flags)]
            turns = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
            at, number = turns[::2] + low, turns[1::2] - turns[::2]
            nth = np.searchsorted(start, at, side="right") - 1
            at, number, nth = (x[own["alone"][nth]] for x in (at, number, nth))
            yield {"row_key": own["row_key"][nth], "low": own["low"][nth] + at - start[nth], "windows": number}


LOT = 2 << 20  # bytes of contexts that are narrowed at once, whole anchors each
KINDS = {"anchor": np.int64, "copies": np.int64, "row_key": np.int64, "low": np.int64, "windows": np.int64, "place": np.int64}


def _columns(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Numbers of a table of contexts, and their bytes with offsets."""
    found = table["bytes"].combine_chunks()
    if isinstance(found, pa.ChunkedArray):
        found = pa.concat_arrays(found.chunks)
    offsets = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
    data = np.frombuffer(found.buffers()[2] or b"", np.uint8)
    return {k: table[k].to_numpy().astype(kind) for k, kind in KINDS.items()}, data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _solved(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans of contexts that occur once as a whole but share an anchor with others; rows of an anchor stand together.

    A task narrows its anchors a lot at a time and sorts what is left as one shard, whose size only its disk bounds.
    """

    def spans(found: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"row_key": pa.array(found["row_key"]), "low": pa.array(found["low"]), "windows": pa.array(found["windows"], pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = Shard(length), [], 0

        def narrow(table: pa.Table) -> pa.RecordBatch:
            settled, left, data = narrowed(*_columns(table), length, gram)
            shard.add(left, data)
            return spans(settled)

        for batch in batches:
            for part in byte_slices(batch, "bytes", LOT):
                held.append(part)
                size += part["bytes"].nbytes
                if size >= LOT:
                    table = pa.Table.from_batches(held)
                    named = table["anchor"].to_numpy()
                    split = int(np.searchsorted(named, named[-1]))  # the last anchor may go on
                    if split:
                        yield narrow(table.slice(0, split))
                    held = pa.Table.from_batches(table.slice(split).to_batches()).combine_chunks().to_batches()
                    size = sum(p["bytes"].nbytes for p in held)
        if held:
            yield narrow(pa.Table.from_batches(held))
        for found in shard.repeated():
            yield spans(found)
        release_memory()

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "anchor").sortWithinPartitions("anchor", "row_key", "low")
    return dealt.mapInArrow(run, "row_key long, low long, windows int")


def _halved(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """Each piece as two: its windows with ``least`` to ``most`` bytes before the anchor, by halves of that range.

    Equal windows have as many bytes before the anchor, so they fall into the same half, and all of its windows have ``least`` bytes before the anchor
    and ``length - gram - most`` bytes after it. ``anchor`` becomes a hash of these with the anchor.
    """
    middle = F.floor((F.col("least") + F.col("most") + 1) / 2).cast("int")
    halves = F.array(F.struct("least", (middle - 1).alias("most")), F.struct(middle.alias("least"), "most"))
    cut = pieces.withColumn("half", F.explode(halves)).withColumns({"least": F.col("half.least"), "most": F.col("half.most")}).where("least <= most")
    cut = cut.withColumns({"first": F.expr("greatest(0, place - most)"), "last": F.expr("least(windows - 1, place - least)")}).where("first <= last")
    shared = F.expr(f"substring(bytes, place - least + 1, least + {length} - most)")
    return cut.select(
        F.xxhash64("anchor", "least", "most", shared).alias("anchor"),
        "copies",
        "row_key",
        (F.col("low") + F.col("first")).alias("low"),
        F.expr("last - first + 1").alias("windows"),
        F.expr("place - first").alias("place"),
        F.expr(f"substring(bytes, first + 1, last - first + {length})").alias("bytes"),
        "least",
        "most",
    )


def _split_hot(contexts: DataFrame, length: int, gram: int, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Spans that are settled, and pieces in groups of at most ``limit``, for contexts of anchors that have more.

    Contexts are halved (see :func:`_halved`) until no group is too large. In each round, pieces that are equal (by 128 bits) repeat as a whole and one goes on, and those
    that are alone in their group are gone. After the last round a piece is one window, and different ones stand alone. Groups are counted before they meet.
    """
    spans, small = [], []
    pieces = contexts.withColumns({"least": F.lit(0), "most": F.lit(length - gram)})
    equal = ["anchor", "place", "name"]
    for _ in range((length - gram).bit_length()):
        parts = stored(_halved(pieces, length, gram).withColumn("name", F.md5("bytes")), "parts")
        kinds = stored(parts.groupBy(*equal).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_key", "low", "windows", "copies", "least", "most", "bytes")).alias("one")), "part_kinds")
        spans.append(parts.where("copies = 1").join(kinds.where("n > 1").select(*equal), equal, "left_semi").select("row_key", "low", "windows"))
        groups = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "part_groups")
        copies = F.when(F.col("n") > 1, F.lit(2).cast("long")).otherwise(F.col("one.copies")).alias("copies")
        open_ = stored(kinds.join(groups, "anchor").select("anchor", copies, *(f"one.{c}" for c in ("row_key", "low", "windows")), "place", *(f"one.{c}" for c in ("bytes", "least", "most")), "members"), "open")
        small.append(open_.where(F.col("members") <= limit))
        pieces = open_.where(F.col("members") > limit).drop("members")
        if pieces.isEmpty():
            break
    return spans, [p.select(*CUT) for p in (*small, pieces)]


CUT = ("anchor", "copies", "row_key", "low", "windows", "place", "bytes")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Windows that start at another place too: ``row_key``, ``low``, ``windows`` (starts from ``low`` on).

    ``texts`` has ``row_key`` (of equal rows only, if it isn't unique) and ``text`` (binary).

    1. Contexts of all windows; those whose anchor occurs once are gone, as none of their windows can repeat.
    2. Contexts that occur more than once as a whole (by a 64-bit hash of all bytes, within the same 64-bit anchor) repeat as a whole; one of them
       goes on. Groups are counted before they meet, so thousands of copies cost one row for each task.
    3. What is left are different contexts around one anchor. Their bytes are cut out of the texts and dealt by
       anchor to one shard a task, which is narrowed (see :func:`narrowed`) and suffix-sorted from disk.
       Anchors with more than ``HOT`` bytes are split before (see :func:`_split_hot`).
    """
    if not 0 < gram <= length:
        raise ValueError(f"an anchor of {gram} bytes doesn't lie within {length}")
    once = texts.groupBy("row_key").agg(F.first("text").alias("text"))  # repeated rows all count, but are cut out of one
    found = _contexts(texts, length, gram)
    # a table of its own, as Spark can split a hot anchor in the join below only if no aggregation runs in the same stage
    often = stored(_contexts(texts, length, gram, names_only=True).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    shared = stored(found.join(often, "anchor"), "contexts")
    kinds = stored(shared.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row_key", "low", "windows", "place")).alias("one")), "kinds")
    whole = shared.join(kinds.where("copies > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select("row_key", "low", "windows")
    several = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    limit = max(1, HOT // (2 * length - gram))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                rows = [(w["anchor"], w["copies"], key, w["low"], w["windows"], w["place"], text[w["low"] : w["low"] + w["windows"] - 1 + length]) for key, text, ws in zip(part["row_key"].to_pylist(), part["text"].to_pylist(), part["wanted"].to_pylist(), strict=True) for w in ws]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["anchor", "copies", "row_key", "low", "windows", "place", "bytes"])

    def cuts(anchors: DataFrame) -> DataFrame:
        open_ = kinds.join(anchors.select("anchor"), "anchor").select("anchor", "copies", "one.*")
        wanted = open_.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "copies", "low", "windows", "place")).alias("wanted"))  # bounded by the text's length
        return once.join(wanted, "row_key").select("row_key", "text", "wanted").mapInArrow(cut, "anchor long, copies long, row_key long, low long, windows int, place int, bytes binary")

    rows, spans = cuts(several.where(F.col("n") <= limit)), []
    hot = several.where(F.col("n") > limit)
    if not hot.isEmpty():
        spans, pieces = _split_hot(cuts(hot), length, gram, limit)
        for p in pieces:
            rows = rows.unionByName(p)
    out = whole.unionByName(stored(_solved(rows, length, gram), "repeats"))
    discard(often, several)
    for p in spans:
        out = out.unionByName(p)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text", as_text: bool = False) -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which also starts anywhere else, in the same text or another.

    With ``as_text`` the text column itself becomes what is kept, less the bytes of characters that were cut in half.
    Strings are judged on the input and matches never cross texts. Adds to each row ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept_bytes`` (binary); columns of these names are replaced, others stay. Null texts count as empty; texts shorter than ``length`` stay whole. Rows that are equal in id and text
    are repeats of each other. An empty table gives no rows. ``gram`` must be at most ``length``.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept_bytes")
    kept = [c for c in docs.columns if c not in new]
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    key = F.xxhash64(F.col(id_column), F.col(text_column))
    rows = bound_batches(docs).select(key.alias("_row_key"), text.alias("_text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(kept) if c != text_column))
    rows = bucketed(rows, "texts", "_row_key")  # texts move once, here; what is found out about them moves to them
    texts = rows.select(F.col("_row_key").alias("row_key"), F.col("_text").alias("text"))
    spans = repeated_spans(texts, length, gram).groupBy("row_key").agg(F.collect_set(F.struct("low", "windows")).alias("spans"))
    joined = rows.join(spans.withColumnRenamed("row_key", "_row_key"), "_row_key", "left")
    names = [f"_{i}" for i, c in enumerate(kept) if c != text_column]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "_text"):
                sizes, removed, runs, left = [], [], [], []
                for data, own in zip(part["_text"].to_pylist(), part["spans"].to_pylist(), strict=True):
                    merged: list[list[int]] = []
                    for a, e in sorted((s["low"], s["low"] + s["windows"] - 1 + length) for s in own or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([a, e])
                    edges = [0, *(x for m in merged for x in m), len(data)]
                    sizes.append(len(data))
                    removed.append(sum(e - a for a, e in merged))
                    runs.append(len(merged))
                    left.append(b"".join(data[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True)))
                text = pa.array([d.decode("utf-8", "ignore").encode() for d in left], pa.binary()) if as_text else part["_text"]
                columns = [*(part[c] for c in names), text, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(left, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "_text", *new])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*names).schema.fields)
    out = joined.select(*names, "_text", "spans").mapInArrow(cut, f"{fields}_text binary, n_bytes long, n_removed long, n_spans long, kept_bytes binary")
    back = [F.col("_text").cast("string").alias(c) if c == text_column else F.col(f"_{i}").alias(c) for i, c in enumerate(kept)]
    return out.select(*back, *new)
