"""Bundles: the binary form of consecutive messages.

A segment file is a row of frames, a varint length and a bundle. A bundle has a header byte (bits 0-1 codec, 2-5 number of
messages if at most 15, 6 explicit sequence numbers, 7 reserved), the number of messages as a varint where it
isn't in the header, for explicit numbers the first one (u64) and, unless there is one message, the last as ``varint(last - first - 1)``, and the messages. A message has
flags (1 key, 2 time of the one before, 4 number after the one before), the number's distance minus 1 where explicit and neither first, last nor flagged, time (u64), key (u8 length), and content (varint length).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa

from ..schemas import MAX_SEQ, CorruptBundle

HAVE_KEY, SAME_TS, NEXT_SEQ = 1, 2, 4
SNAPPY = 1
COMPRESS_MESSAGES, COMPRESS_BYTES = 512, 1024


def varint(value: int) -> bytes:
    """An unsigned number of 32 bits in groups of seven, the lowest first."""
    if not 0 <= value < 1 << 32:
        raise ValueError(value)
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= end or shift > 28:
            raise CorruptBundle("a number is cut off")
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


@dataclass(frozen=True)
class Message:
    seq: int
    ts_ms: int
    key: bytes | None
    content: bytes


@dataclass(frozen=True)
class Header:
    """What stands before a bundle's messages; ``body`` is their place in the data that it was read from."""

    codec: int
    count: int
    sparse: bool
    first: int
    last: int
    body: int = 0

    def frame(self, messages: bytes) -> bytes:
        """The frame of a bundle with these encoded messages."""
        out = bytearray([self.codec | (self.count << 2 if self.count <= 15 else 0) | (64 if self.sparse else 0)])
        if self.count > 15:
            out += varint(self.count)
        if self.sparse:
            out += struct.pack("<Q", self.first)
            if self.count > 1:
                out += varint(self.last - self.first - 1)
        out += pa.compress(messages, codec="snappy", asbytes=True) if self.codec == SNAPPY else messages
        return varint(len(out)) + bytes(out)


def encode_bundle(messages: Sequence[Message], sparse: bool = False, snappy: bool | None = None) -> bytes:
    """A frame of messages in order. ``snappy`` None: for more than 512 messages or 1024 bytes. A key has at most 255 bytes."""
    if not messages:
        raise ValueError("a bundle needs a message")
    count, body, ts = len(messages), bytearray(), None
    for i, m in enumerate(messages):
        if len(m.key or b"") > 255:
            raise CorruptBundle(f"a key of {len(m.key)} bytes is longer than 255")
        flags = (HAVE_KEY if m.key else 0) | (SAME_TS if m.ts_ms == ts else 0)
        inner = sparse and 0 < i < count - 1
        follows = inner and m.seq == messages[i - 1].seq + 1
        body.append(flags | (NEXT_SEQ if follows else 0))
        if inner and not follows:
            body += varint(m.seq - messages[i - 1].seq - 1)
        if m.ts_ms != ts:
            body += struct.pack("<Q", m.ts_ms)
            ts = m.ts_ms
        if m.key:
            body.append(len(m.key))
            body += m.key
        body += varint(len(m.content)) + m.content
    if snappy is None:
        snappy = count > COMPRESS_MESSAGES or len(body) > COMPRESS_BYTES
    return Header(SNAPPY if snappy else 0, count, sparse, messages[0].seq, messages[-1].seq).frame(bytes(body))


def bundle_header(data: bytes, at: int, end: int, base: int) -> Header:
    """Header of the bundle ``data[at:end]``; dense messages are numbered from ``base`` on."""
    if at >= end:
        raise CorruptBundle("an empty bundle")
    head = data[at]
    at += 1
    if head & 128:
        raise CorruptBundle("a reserved header bit is set")
    codec, count, sparse = head & 3, head >> 2 & 15, bool(head & 64)
    if codec > SNAPPY:
        raise CorruptBundle(f"unknown codec {codec}")
    if not count:
        count, at = read_varint(data, at, end)
    if not count or count > max(end - at, 1) and codec != SNAPPY:
        raise CorruptBundle("more messages than bytes")
    first, last = base, base + count - 1
    if sparse:
        if at + 8 > end:
            raise CorruptBundle("the first number is cut off")
        first = last = struct.unpack_from("<Q", data, at)[0]
        at += 8
        if count > 1:
            gap, at = read_varint(data, at, end)
            last = first + gap + 1
    if last > MAX_SEQ:
        raise CorruptBundle(f"sequence number {last} is too large")
    return Header(codec, count, sparse, first, last, at)


def frame_of(data: bytes, at: int, end: int, on_truncated: str) -> tuple[int, int] | None:
    """Start and end of the bundle whose frame starts at ``at``; null or an error where it is cut off."""
    try:
        size, start = read_varint(data, at, end)
    except CorruptBundle:
        if on_truncated == "stop" and end - at < 5:
            return None
        raise
    if start + size > end:
        if on_truncated == "stop":
            return None
        raise CorruptBundle("the last bundle is cut off")
    return start, start + size


def decode_bundle(data: bytes, at: int, end: int, base: int) -> tuple[list[Message], int]:
    """Messages of the bundle ``data[at:end]`` and the next sequence number; dense ones are numbered from ``base`` on."""
    head = bundle_header(data, at, end, base)
    codec, count, sparse, first, last, at = head.codec, head.count, head.sparse, head.first, head.last, head.body
    data = data[:end]
    if codec == SNAPPY:
        try:
            size, _ = read_varint(data, at, end)
            data, at = pa.decompress(data[at:end], decompressed_size=size, codec="snappy", asbytes=True), 0
        except (pa.ArrowException, OSError) as e:
            raise CorruptBundle(str(e)) from e
    end = len(data)
    out: list[Message] = []
    ts, seq = None, first - 1
    for i in range(count):
        if at >= end:
            raise CorruptBundle("messages are cut off")
        flags = data[at]
        at += 1
        if sparse and i == 0:
            seq = first
        elif sparse and i == count - 1:
            seq = last
        elif sparse and not flags & NEXT_SEQ:
            delta, at = read_varint(data, at, end)
            seq += delta + 1
        else:
            seq += 1
        if not flags & SAME_TS:
            if at + 8 > end:
                raise CorruptBundle("a time is cut off")
            ts = struct.unpack_from("<Q", data, at)[0]
            at += 8
        elif ts is None:
            raise CorruptBundle("the first message has no time")
        key = None
        if flags & HAVE_KEY:
            if at >= end or at + 1 + data[at] > end:
                raise CorruptBundle("a key is cut off")
            key = data[at + 1 : at + 1 + data[at]] or None
            at += 1 + data[at]
        size, at = read_varint(data, at, end)
        if at + size > end:
            raise CorruptBundle("content is cut off")
        out.append(Message(seq, ts, key, data[at : at + size]))
        at += size
    if at != end:
        raise CorruptBundle("bytes are left in the bundle")
    return out, last + 1


def decode_segment(data: bytes, base: int, on_truncated: str = "stop") -> Iterator[list[Message]]:
    """Bundles of a segment. A last bundle that is cut off ends it quietly (``stop``) or raises (``error``)."""
    at, end = 0, len(data)
    while at < end:
        found = frame_of(data, at, end, on_truncated)
        if found is None:
            return
        messages, base = decode_bundle(data, *found, base)
        yield messages
        at = found[1]
