import pytest

from loamlog.llm import media


@pytest.mark.parametrize("size", [128, 200, 1600, 5000])
def test_tag_in_the_text(size):
    """'TAG' where an ID3v1 tag would start is text if a frame covers it."""
    data = media.encode_stream(b"x" * size)
    before = data[:-128].count(b"x")
    payload = b"x" * before + b"TAG" + b"x" * (size - before - 3)
    data = media.encode_stream(payload)
    assert len(payload) == size and data[-128:-125] == b"TAG"
    found = media.parse_stream(data)
    assert media.payload_of(data, found) == payload and found.skipped == 0 and "ID3v1" not in found.tags


@pytest.mark.parametrize("size", [0, 65, 5000])
def test_real_tag(size):
    payload = b"y" * size
    data = media.encode_stream(payload) + b"TAG" + b"song".ljust(125, b"\0")
    found = media.parse_stream(data)
    assert media.payload_of(data, found) == payload
    assert found.tags["ID3v1"] == b"song".ljust(125, b"\0") and found.skipped == 0


def test_short_payload_is_an_error():
    data = media.encode_stream(b"z" * 5000)
    found = media.parse_stream(data)
    cut = data[: found.offsets[-1]]
    with pytest.raises(ValueError):
        media.payload_of(cut, media.parse_stream(cut))


@pytest.mark.parametrize("word", [b"TAG", b"ID3\x04\0\0\0\0\0\x0a", b"Xing\0\0\0\x0f", b"Info\0\0\0\x0f", b"\xff\xfb\x90\x64", b"\xff\xfa\x90\x64", b"APETAGEX"])
def test_words_of_the_format_at_every_place(word):
    """A payload is bytes: what looks like a tag, a table or a frame in it is none."""
    size = 1024
    for at in range(size - len(word) + 1):
        payload = b"a" * at + word + b"b" * (size - at - len(word))
        data = media.encode_stream(payload)
        found = media.parse_stream(data)
        assert media.payload_of(data, found) == payload, at
        assert found.skipped == 0 and found.offsets == sorted(found.offsets)
