"""Messages of many bundles at once as columns, to and from the bytes of :mod:`loamlog.sources.encoding`.

Decoding walks all bundles in step: the first message of each, then the second of each, and so on, with numpy. Encoding knows all sizes beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..schemas import CorruptBundle
from .encoding import COMPRESS_BYTES, COMPRESS_MESSAGES, HAVE_KEY, NEXT_SEQ, SAME_TS, SNAPPY, Header, bundle_header, frame_of, read_varint

BATCH_BYTES = 8 << 20  # decompressed bodies that are decoded at once


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s+n]`` for each start and length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def spread(out: np.ndarray, to: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Write ``flat[s:s+n]`` to ``out`` from each ``to`` on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    own = np.arange(total)
    out[np.repeat(to - (ends - lengths), lengths) + own] = flat[np.repeat(starts - (ends - lengths), lengths) + own]


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, start and length of each value of a binary column; a null has length 0."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    lengths = np.diff(offsets)
    if values.null_count:
        lengths = np.where(values.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8), offsets[:-1], lengths


def column_of(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The binary column of ``flat[s:s+n]``."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    bitmap = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(starts), [bitmap, pa.py_buffer(offsets), pa.py_buffer(gather(flat, starts, lengths))])


@dataclass
class Bundles:
    """Headers of bundles, and their decompressed bodies one after another."""

    headers: list[Header]
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _varints(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number at each place, the places after them, and which are cut off or too long."""
    value, at, going, bad = np.zeros(len(at), np.int64), at.copy(), np.ones(len(at), bool), np.zeros(len(at), bool)
    for shift in range(0, 35, 7):
        bad |= going & (at >= ends)
        going &= at < ends
        byte = data[np.minimum(at, len(data) - 1)].astype(np.int64)
        value = np.where(going, value | (byte & 127) << shift, value)
        at = at + going
        going &= byte > 127
        if not going.any():
            break
    return value, at, bad | going


def decode_bodies(bundles: Bundles) -> dict[str, np.ndarray]:
    """Of each message, by bundle and place: ``seq``, ``ts_ms``, ``key_at``, ``key_size`` (0: none), ``at`` and ``size`` of the content, and ``bundle``.

    Raises :class:`CorruptBundle` where the bytes don't hold what the headers say.
    """
    heads = bundles.headers
    count = np.array([h.count for h in heads], np.int64)
    sparse = np.array([h.sparse for h in heads], bool)
    first, last = (np.array([getattr(h, k) for h in heads], np.int64) for k in ("first", "last"))
    place = np.cumsum(count) - count
    out = {k: np.zeros(int(count.sum()), np.int64) for k in ("seq", "ts_ms", "key_at", "key_size", "at", "size")}
    at, data = bundles.starts.astype(np.int64).copy(), np.append(bundles.data, np.zeros(8, np.uint8))
    seq, ts = first - 1, np.zeros(len(heads), np.int64)
    own = np.arange(len(heads))
    order = np.argsort(-count, kind="stable")  # bundles that still have messages are a prefix
    falling = count[order]
    for i in range(int(count.max()) if len(heads) else 0):
        own = order[: int(np.searchsorted(-falling, -i, side="left"))]
        p, e = at[own], bundles.ends[own]
        bad = p >= e
        flags = data[np.minimum(p, len(data) - 1)]
        p = p + 1
        step = np.ones(len(own), np.int64)
        jump = np.flatnonzero(sparse[own] & (flags & NEXT_SEQ == 0) & (i > 0) & (i < count[own] - 1))
        if len(jump):
            delta, p[jump], wrong = _varints(data, p[jump], e[jump])
            step[jump] += delta
            bad[jump] |= wrong
        now = np.where(sparse[own] & (i == count[own] - 1), last[own], seq[own] + step) if i else first[own]
        fresh = np.flatnonzero(flags & SAME_TS == 0)
        bad |= (flags & SAME_TS > 0) & (i == 0)
        bad[fresh] |= p[fresh] + 8 > e[fresh]
        held = ts[own]
        held[fresh] = data[np.minimum(p[fresh], len(data) - 8)[:, None] + np.arange(8)].view("<i8").reshape(-1)
        p[fresh] += 8
        keyed = np.flatnonzero(flags & HAVE_KEY)
        size = np.zeros(len(own), np.int64)
        size[keyed] = data[np.minimum(p[keyed], len(data) - 1)]
        bad[keyed] |= p[keyed] + 1 + size[keyed] > e[keyed]
        key_at = p + 1
        p[keyed] += 1 + size[keyed]
        length, p, wrong = _varints(data, p, e)
        bad |= wrong | (p + length > e)
        if bad.any():
            raise CorruptBundle("messages are cut off")
        to = place[own] + i
        for k, v in (("seq", now), ("ts_ms", held), ("key_at", key_at), ("key_size", size), ("at", p), ("size", length)):
            out[k][to] = v
        seq[own], ts[own], at[own] = now, held, p + length
    if (at != bundles.ends).any():
        raise CorruptBundle("bytes are left in the bundle")
    out["bundle"] = np.repeat(np.arange(len(heads)), count)
    return out


def scan_bundles(data: bytes, base: int, on_truncated: str = "stop", low: int = 0, high: int | None = None) -> Iterator[tuple[Header, bytes]]:
    """Header and decompressed body of each bundle of a segment that has numbers from ``low`` to ``high``; others are passed by unread."""
    at, end = 0, len(data)
    while at < end:
        found = frame_of(data, at, end, on_truncated)
        if found is None:
            return
        start, stop = found
        head = bundle_header(data, start, stop, base)
        base, at = head.last + 1, stop
        if head.last < low:
            continue
        if high is not None and head.first > high:
            return
        body = data[head.body : stop]
        if head.codec == SNAPPY:
            try:
                body = pa.decompress(body, decompressed_size=read_varint(body, 0, len(body))[0], codec="snappy", asbytes=True)
            except (pa.ArrowException, OSError) as e:
                raise CorruptBundle(str(e)) from e
        if head.count > len(body):
            raise CorruptBundle("more messages than bytes")
        yield head, body


def joined(found: list[tuple[Header, bytes]]) -> Bundles:
    sizes = np.array([len(b) for _, b in found], np.int64)
    ends = np.cumsum(sizes)
    return Bundles([h for h, _ in found], np.frombuffer(b"".join(b for _, b in found), np.uint8), ends - sizes, ends)


def in_batches(found: Iterator[tuple[Header, bytes]]) -> Iterator[Bundles]:
    """Bundles by about ``BATCH_BYTES`` of bodies."""
    held, size = [], 0
    for head, body in found:
        held.append((head, body))
        size += len(body)
        if size >= BATCH_BYTES:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def _varint_sizes(values: np.ndarray) -> np.ndarray:
    return 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21) + (values >= 1 << 28)


def _put_varints(out: np.ndarray, to: np.ndarray, values: np.ndarray) -> None:
    sizes = _varint_sizes(values)
    for k in range(5):
        own = np.flatnonzero(sizes > k)
        out[to[own] + k] = (values[own] >> 7 * k & 127 | np.where(sizes[own] > k + 1, 128, 0)).astype(np.uint8)


def encode_bundles(seq: np.ndarray, ts: np.ndarray, key: pa.Array, content: pa.Array, starts: np.ndarray, expected: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The frames of bundles that begin at rows ``starts``, and which are sparse: those with a gap, or whose first number isn't ``expected``."""
    n = len(seq)
    key_data, key_at, key_size = bytes_of(key)
    data, at, size = bytes_of(content)
    if len(key_size) and key_size.max() > 255:
        raise CorruptBundle(f"a key of {int(key_size.max())} bytes is longer than 255")
    counts = np.diff(np.append(starts, n))
    bundle = np.repeat(np.arange(len(starts)), counts)
    place = np.arange(n) - starts[bundle]
    ends = starts + counts - 1
    sparse = (seq[starts] != expected) | (seq[ends] - seq[starts] + 1 != counts)
    begins = place == 0
    same = ~begins & (ts == np.concatenate([[0], ts[:-1]]))
    step = seq - np.concatenate([[0], seq[:-1]])
    inner = sparse[bundle] & ~begins & (place < counts[bundle] - 1)
    follows, jumps = inner & (step == 1), inner & (step != 1)
    keyed = key_size > 0
    delta_size = np.where(jumps, _varint_sizes(step - 1), 0)
    head = 1 + delta_size + np.where(same, 0, 8) + np.where(keyed, 1 + key_size, 0)
    total = head + _varint_sizes(size) + size
    offsets = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(int(offsets[-1]), np.uint8)
    p = offsets[:-1].copy()
    out[p] = (np.where(keyed, HAVE_KEY, 0) | np.where(same, SAME_TS, 0) | np.where(follows, NEXT_SEQ, 0)).astype(np.uint8)
    p += 1
    own = np.flatnonzero(jumps)
    _put_varints(out, p[own], step[own] - 1)
    p += delta_size
    own = np.flatnonzero(~same)
    out[p[own][:, None] + np.arange(8)] = ts[own].astype("<i8").view(np.uint8).reshape(-1, 8)
    p[own] += 8
    own = np.flatnonzero(keyed)
    out[p[own]] = key_size[own]
    spread(out, p[own] + 1, key_data, key_at[own], key_size[own])
    p[own] += 1 + key_size[own]
    _put_varints(out, p, size)
    spread(out, p + _varint_sizes(size), data, at, size)
    body, bounds = out.tobytes(), np.append(offsets[starts], offsets[-1]).tolist()
    frames = []
    for k, (a, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        number = int(counts[k])
        head_ = Header(SNAPPY if number > COMPRESS_MESSAGES or e - a > COMPRESS_BYTES else 0, number, bool(sparse[k]), int(seq[starts[k]]), int(seq[ends[k]]))
        frames.append(head_.frame(body[a:e]))
    return frames, sparse
