import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loamlog.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_round_trip(payload):
    data = media.encode_stream(payload)
    found = media.parse_stream(data)
    assert media.payload_of(data, found) == payload
    assert found.skipped == 0 and media.checksum_errors(data, found) == 0
    xing = data.index(b"Xing") - 23 if payload else 0
    assert not payload or found.vbr == {"frames": len(found.offsets), "bytes": len(data) - xing}
    assert found.samples == 1152 * len(found.offsets)


def test_headers_in_the_payload_do_not_mislead():
    payload = bytes.fromhex("fffb90c0") * 2000
    data = media.encode_stream(payload)
    assert media.payload_of(data, media.parse_stream(data)) == payload


def test_resynchronises_after_foreign_bytes():
    payload = bytes(range(256)) * 40
    data = media.encode_stream(payload)
    clean = media.parse_stream(data)
    r = random.Random(1)
    at = clean.offsets[3]
    junk = bytes(r.choice([0, 1, 0xFF, 0xE0]) for _ in range(77))
    torn = data[:at] + junk + data[at:]
    found = media.parse_stream(torn)
    assert media.payload_of(torn, found) == payload and found.skipped == 77
    assert found.offsets == [o + 77 * (o >= at) for o in clean.offsets]


def test_checksums():
    data = bytearray(media.encode_stream(b"x" * 5000))
    found = media.parse_stream(bytes(data))
    data[found.offsets[1] + 8] ^= 1
    assert media.checksum_errors(bytes(data), media.parse_stream(bytes(data))) == 1


def test_crc_known_value():
    import numpy as np

    assert int(media.crc16(np.frombuffer(b"123456789", np.uint8)[None])[0]) == 0xAEE7


def test_header_lengths():
    found = media.parse_header(0xFFFB9064)
    assert (found.version, found.layer, found.bitrate, found.rate, found.length, found.samples) == (1, 3, 128_000, 44_100, 417, 1152)
    assert media.parse_header(0xFFFFFFFF) is None and media.parse_header(0) is None


def test_table(spark, documents, texts):
    rows = media.index_media(media.store_media(documents(texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = (texts[r.doc_id] or "").encode()
        padded = own + bytes(-len(own) % 64 or (0 if own else 64))
        assert (r.n_bytes, bytes(r.payload)) == (len(own), padded)
        assert r.checksum_errors == r.skipped_bytes == 0 and r.frames == r.vbr_frames == len(r.frame_offsets)
        assert r.samples == 1152 * r.frames and r.sample_rate == 32_000


def test_other_bytes_and_empty_tables(spark, documents):
    rows = spark.createDataFrame([(None,), (b"",), (b"ID3",), (b"no audio at all",), (b"\xff" * 50,)], "media binary")
    assert [(r.payload, r.frames) for r in media.index_media(rows).collect()] == [(None, 0)] * 5
    assert media.index_media(media.store_media(documents([]).limit(0))).count() == 0
