"""MPEG audio columns: payload bytes in Layer III frames, and the index of any MPEG audio stream.

A payload is carried as ancillary data of CRC-protected mono frames of MPEG-1 Layer III with a
variable bit rate: an ID3v2.4 tag whose private frame names the payload's length, a Xing frame
(frames, bytes, seek table), then the data frames. Full frames have the highest bit rate, the last one the
least that holds the rest. Reading resynchronises at frame headers, so foreign bytes between
frames cost nothing but themselves.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, byte_slices, stored

# Fixed values of the MPEG audio standards (ISO/IEC 11172-3 and 13818-3): kbit/s by index 1 to 14.
BITRATES = {
    (1, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}
OWNER = b"loamlog.payload"
PAD = 64


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    length: int
    samples: int
    side: int  # bytes of side information that the checksum of Layer III covers


@lru_cache(65536)
def parse_header(word: int) -> Header | None:
    """The four bytes of a frame header, as a big-endian number; None if they are none. Free format is none."""
    if word >> 21 != 0x7FF:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    bits, rate = word >> 12 & 15, word >> 10 & 3
    if version is None or layer == 4 or bits in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    bitrate, hz = 1000 * BITRATES[1 if version == 1 else 2, layer][bits - 1], RATES[version][rate]
    pad, mono = word >> 9 & 1, word >> 6 & 3 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    length = (12 * bitrate // hz + pad) * 4 if layer == 1 else samples // 8 * bitrate // hz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, not word >> 16 & 1, bitrate, hz, mono, length, samples, side)


def _crc_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        values = np.where(values & 0x8000, values << 1 ^ 0x8005, values << 1) & 0xFFFF
    return values.astype(np.uint16)


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of MPEG audio (polynomial 0x8005, start 0xFFFF) for each row of bytes."""
    value = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        value = (value << np.uint16(8)) ^ CRC[(value >> np.uint16(8)).astype(np.uint8) ^ column]
    return value


@lru_cache(64)
def _frame_start(bits: int) -> tuple[bytes, int]:
    """Header, checksum and silent side information of a mono MPEG-1 Layer III frame at 32 kHz; bytes left in it."""
    word = 0x7FF << 21 | 3 << 19 | 1 << 17 | bits << 12 | 2 << 10 | 3 << 6
    head, side = word.to_bytes(4, "big"), bytes(17)
    crc = int(crc16(np.frombuffer(head[2:] + side, np.uint8)[None])[0])
    return head + crc.to_bytes(2, "big") + side, parse_header(word).length - 23


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode_stream(payload: bytes) -> bytes:
    """A payload as an MPEG audio stream."""
    full, room = _frame_start(14)
    frames = [full + payload[i : i + room] for i in range(0, len(payload) - room + 1, room)]
    if rest := payload[len(frames) * room :]:
        bits = next(b for b in range(1, 15) if _frame_start(b)[1] >= len(rest))
        start, last = _frame_start(bits)
        frames.append(start + rest + bytes(last - len(rest)))
    private = OWNER + b"\0" + struct.pack(">Q", len(payload))
    tag = b"PRIV" + _syncsafe(len(private)) + b"\0\0" + private
    start, left = _frame_start(4)
    size = len(start) + left + sum(map(len, frames))
    first = len(start) + left
    toc = bytes(min(255, (first + (len(frames) * k // 100) * len(full)) * 256 // size) for k in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), size) + toc
    return b"ID3\4\0\0" + _syncsafe(len(tag)) + tag + start + xing + bytes(left - len(xing)) + b"".join(frames)


@dataclass
class Stream:
    """What a stream holds."""

    tags: dict[str, bytes] = field(default_factory=dict)
    vbr: dict[str, int] = field(default_factory=dict)
    toc: bytes = b""
    rate: int = 0
    samples: int = 0
    bitrates: set[int] = field(default_factory=set)
    skipped: int = 0
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    bodies: list[int] = field(default_factory=list)
    protected: list[bool] = field(default_factory=list)
    payload_bytes: int | None = None


def _id3v2(data: bytes, at: int, into: dict[str, bytes]) -> int:
    size = sum((b & 127) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
    end = min(len(data), at + 10 + size)
    major, p = data[at + 3], at + 10
    while p + 10 <= end and data[p]:
        n = int.from_bytes(data[p + 4 : p + 8], "big") if major < 4 else sum((b & 127) << s for b, s in zip(data[p + 4 : p + 8], (21, 14, 7, 0), strict=True))
        into.setdefault(data[p : p + 4].decode("latin-1"), data[p + 10 : min(end, p + 10 + n)])
        p += 10 + n
    return at + 10 + size + (10 if data[at + 5] & 16 else 0)


def parse_stream(data: bytes) -> Stream:
    """Tags, variable-bit-rate table, exact number of samples and offset of each frame.

    A header counts if the next frame's header follows at its end or the stream (or a trailing tag)
    ends there; else the search goes on at the next sync byte. A stream's frames share
    version, layer and sampling rate. The last 128 bytes are an ID3v1 tag if they start as one and
    no frame reaches into them.
    """
    if data[-128:-125] == b"TAG":
        out, across = _frames(data, len(data))
        if not across:
            out, _ = _frames(data, len(data) - 128)
            out.tags["ID3v1"] = data[-125:]
        return out
    return _frames(data, len(data))[0]


def _frames(data: bytes, end: int) -> tuple[Stream, bool]:
    """What the bytes before ``end`` hold, and whether a frame reaches into the last 128 bytes from before."""
    out, at = Stream(), 0
    kind, across = None, False
    while at + 4 <= end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _id3v2(data, at, out.tags)
            continue
        head = parse_header(int.from_bytes(data[at : at + 4], "big"))
        if head is not None and (kind is None or kind == (head.version, head.layer, head.rate)):
            to = at + head.length
            then = parse_header(int.from_bytes(data[to : to + 4], "big")) if to + 4 <= end else None
            if to == end or data[to : to + 3] == b"ID3" or then and (then.version, then.layer, then.rate) == (head.version, head.layer, head.rate) or (kind and to <= end and then is None):
                body = at + 4 + 2 * head.protected + head.side
                if kind is None and data[body : body + 4] in (b"Xing", b"Info"):
                    flags, p = struct.unpack_from(">I", data, body + 4)[0], body + 8
                    for bit, name in ((1, "frames"), (2, "bytes")):
                        if flags & bit:
                            out.vbr[name] = struct.unpack_from(">I", data, p)[0]
                            p += 4
                    out.toc = data[p : p + 100] if flags & 4 else b""
                elif kind is None and data[at + 36 : at + 40] == b"VBRI":
                    out.vbr["bytes"], out.vbr["frames"] = struct.unpack_from(">II", data, at + 46)
                else:
                    out.offsets.append(at)
                    out.lengths.append(head.length)
                    out.bodies.append(body)
                    out.samples += head.samples
                    out.bitrates.add(head.bitrate)
                    out.protected.append(head.protected and head.layer == 3)
                across |= at < len(data) - 128 < to
                kind, out.rate = (head.version, head.layer, head.rate), head.rate
                at = to
                continue
        found = data.find(b"\xff", at + 1, end)
        found = end if found < 0 else found
        out.skipped += found - at
        at = found
    private = out.tags.get("PRIV", b"")
    if private.startswith(OWNER + b"\0"):
        out.payload_bytes = struct.unpack_from(">Q", private, len(OWNER) + 1)[0]
    return out, across


def payload_of(data: bytes, stream: Stream) -> bytes | None:
    """The payload that :func:`encode_stream` stored; None for other streams. A stream that lacks a part of it is an error."""
    if stream.payload_bytes is None:
        return None
    found = b"".join(data[b : o + n] for b, o, n in zip(stream.bodies, stream.offsets, stream.lengths, strict=True))[: stream.payload_bytes]
    if len(found) != stream.payload_bytes:
        raise ValueError(f"{len(found)} of {stream.payload_bytes} payload bytes are there")
    return found


def checksum_errors(data: bytes, stream: Stream) -> int:
    """Layer III frames whose stored checksum differs from that of their header and side information."""
    if not any(stream.protected):
        return 0
    raw, bodies, at = np.frombuffer(data, np.uint8), np.array(stream.bodies), np.array(stream.offsets)
    wrong = 0
    for side in set((bodies - at - 6)[stream.protected].tolist()):
        own = at[np.array(stream.protected) & (bodies - at - 6 == side)]
        covered = np.concatenate([raw[own[:, None] + [2, 3]], raw[own[:, None] + 6 + np.arange(side)]], axis=1)
        kept = raw[own + 4].astype(np.uint16) << np.uint16(8) | raw[own + 5]
        wrong += int((crc16(covered) != kept).sum())
    return wrong


def encode_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Texts as MPEG audio columns: ``doc_id``, ``n_bytes`` (UTF-8 bytes of the text) and ``media``.

    The payload is the text with bytes 0 up to a positive multiple of 64, so a null or empty text has
    64 bytes. Other columns are not read; repeated rows stay.
    """
    rows = bound_batches(docs).select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                texts = part["text"].to_pylist()
                media = [encode_stream(t + bytes(-len(t) % PAD or (0 if t else PAD))) for t in texts]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


MEDIA_FIELDS = T.StructType(
    [
        T.StructField("payload", T.BinaryType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("samples", T.LongType()),
        T.StructField("frames", T.IntegerType()),
        T.StructField("frame_offsets", T.ArrayType(T.LongType())),
        T.StructField("bitrates", T.ArrayType(T.IntegerType())),
        T.StructField("vbr_frames", T.LongType()),
        T.StructField("vbr_bytes", T.LongType()),
        T.StructField("checksum_errors", T.IntegerType()),
        T.StructField("skipped_bytes", T.LongType()),
    ]
)


def index_media(media: DataFrame, column: str = "media") -> DataFrame:
    """Add what each MPEG audio stream holds, see ``MEDIA_FIELDS``; the exact duration is ``samples / sample_rate`` s.

    Columns of ``media`` with these names are replaced. A null stream, or bytes without a frame, have no frames and a null payload.
    """
    kept = [c for c in media.columns if c not in MEDIA_FIELDS.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, column):
                rows = []
                for data in part[column].to_pylist():
                    data = data or b""
                    s = parse_stream(data)
                    rows.append((payload_of(data, s), s.rate, s.samples, len(s.offsets), s.offsets, sorted(s.bitrates), s.vbr.get("frames"), s.vbr.get("bytes"), checksum_errors(data, s), s.skipped))
                kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *new], names=[*kept, *MEDIA_FIELDS.names])

    rows = bound_batches(media).select(*kept)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *MEDIA_FIELDS.fields]))


def store_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """:func:`encode_media` as a table in the shared folder."""
    return stored(encode_media(docs, id_column, text_column), "media")
