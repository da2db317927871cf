import hashlib

import pytest

from loamlog.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i} a\r\nb", h, "e") for i, h in rows], "page_id long, url string, html string, payload_digest string")


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 99\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"


def rows():
    big, other = "x" * 1500, "é" * 600
    return [(0, None), (1, ""), (2, "small"), (3, "small"), (4, big), (5, big), (6, big), (7, other), (8, other + "y"), (9, FAKE * 30), (10, FAKE), (11, "\n" * 3000), (12, "WARC/1.1\r\n" * 500), (4, big)]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_round_trip(spark, packed, split):
    found = warc.write_archives(warc.with_revisits(pages(spark, rows())).coalesce(2), packed=packed)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.digest, r.full_bytes, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(found, split).collect())
    want = []
    for i, h in rows():
        data = (h or "").encode()
        revisit = i in (4, 5)
        want.append((i, "revisit" if revisit else "response", 6 if revisit else None, hashlib.sha1(data).hexdigest(), len(data), None if revisit else data))
    assert got == sorted(want, key=lambda x: x[:2])


def test_magic_in_payloads_is_a_candidate_but_not_reached(spark):
    found = warc.write_archives(warc.with_revisits(pages(spark, rows())).coalesce(1), packed=False)
    assert warc.candidates(found, 1000).count() > len(rows()) + 30
    reached = warc.entries(found, 1000).collect()
    assert len({r.split for r in reached}) == len(reached)


def test_damage_raises(spark, tmp_path):
    found = warc.write_archives(warc.with_revisits(pages(spark, rows())).coalesce(1), path=f"file://{tmp_path}", packed=False)
    path = found.first().path.removeprefix("file://")
    data = open(path, "rb").read()
    at = data.rindex(b"X-Page-ID: ")
    open(path, "wb").write(data[:at] + data[at:].replace(b"Content-Length: ", b"Content-Lengtg: ", 1))
    with pytest.raises(Exception, match="no record at"):
        warc.read_archives(found, 4000).count()


def test_empty_and_null_ids(spark):
    assert warc.read_archives(warc.write_archives(warc.with_revisits(pages(spark, [(1, "a")]).limit(0)))).count() == 0
    got = warc.read_archives(warc.write_archives(warc.with_revisits(pages(spark, [(None, "z" * 1200), (None, "z" * 1200), (7, "z" * 1200)])))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 7), (0, "revisit", 7), (7, "response", None)]
