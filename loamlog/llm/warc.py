"""WARC archives: writing with revisit records, and split reading with boundary-chain verification."""

from __future__ import annotations

import gzip
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, byte_slices, checkpointed, open_fs, shared_path

MAGIC = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
CHUNK = 32 << 10
MAX_HEADER = 64 << 10
SPLIT_BYTES = 8 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTH = re.compile(rb"\r\nContent-Length: *(\d+) *(?=\r\n)", re.I)
SAME = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs of RFC 4122

PLACES = "path string, size long, records long"


def _header_value(value: object) -> str:
    """A header value in one line: control characters and spaces of a URI are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *((k, v) for k, v in fields if v is not None), ("Content-Length", len(block))]
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SAME, str(page_id))}>"


def page_record(page_id: object, url: object, payload: bytes, size: int, digest: str, refers_to: object, date: str) -> bytes:
    """A response record, or with ``refers_to`` a revisit record without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _header_value(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page_id)]
    if refers_to is None:
        return _record("response", fields, http + payload)
    return _record("revisit", [*fields, ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", refers_to)], http)


def with_revisits(pages: DataFrame, min_bytes: int = 1000, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload`` (UTF-8, null: empty), ``payload_bytes``, ``payload_digest`` (SHA-1), ``refers_to``.

    Of equal payloads of at least ``min_bytes`` the rows with the largest id refer to nothing, the others to it.
    Only a digest, its largest id and a count are gathered for each group; smaller payloads are joined by a
    key of their own, so many equal ones don't meet. Rows without an id never are the largest; where a group
    has no id at all, its rows refer to nothing.
    """
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = rows.where(F.col("payload_bytes") >= min_bytes)
    groups = large.groupBy(F.col("payload_digest").alias("_key")).agg(F.max("page_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    own = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.xxhash64("url", "page_id").cast("string"))
    keyed = rows.withColumn("_key", F.when(F.col("payload_bytes") >= min_bytes, F.col("payload_digest")).otherwise(own))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_keep")), F.col("_keep"))
    return keyed.join(groups, "_key", "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, path: str | None = None, date: str = "1970-01-01T00:00:00Z", packed: bool = True) -> DataFrame:
    """Write rows of :func:`with_revisits` as archives, one for each partition; returns their manifest.

    With ``packed`` each record is a gzip member of its own, as is usual for archives.

    The manifest (``path``, ``size``, ``records``) is checkpointed and alone says which files count: each
    attempt of a task writes a file of its own. An empty table gives an empty manifest.
    """
    base = path or shared_path(records.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc{'.gz' * packed}"
        seal = (lambda record: gzip.compress(record, 6, mtime=0)) if packed else bytes
        out, size, records = None, 0, 0
        for batch in batches:
            for part in byte_slices(batch, "payload"):
                if out is None:
                    fs, at = open_fs(target)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                    size += out.write(seal(_record("warcinfo", [("WARC-Record-ID", record_id(target)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                columns = [part[c].to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")]
                size += out.write(b"".join(seal(page_record(*row, date)) for row in zip(*columns, strict=True)))
                records += len(part)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [target], "size": [size], "records": [records]})

    ready = bound_batches(records).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "refers_to")
    return checkpointed(ready.mapInArrow(_filled(write), PLACES))


def _filled(write):
    """A revisit's payload isn't sent to Python; there it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from write(b.set_column(2, "payload", b["payload"].fill_null(b"")) for b in batches)

    return run


class Bytes:
    """Bytes of an archive from ``base`` on: a part in memory, what follows read from the file where it is needed."""

    def __init__(self, file, base: int, length: int):
        file.seek(0)
        self.packed = file.read(2) == GZIP[:2]
        file.seek(base)
        self.file, self.base, self.data = file, base, file.read(length)

    def candidates(self, end: int) -> Iterator[int]:
        """Where magic stands before ``end``, both relative to the base."""
        magic = GZIP if self.packed else MAGIC
        p = self.data.find(magic)
        while 0 <= p < end:
            yield p
            p = self.data.find(magic, p + 1)

    def _from(self, p: int) -> Iterator[bytes]:
        while p < len(self.data):
            yield self.data[p : p + CHUNK]
            p += CHUNK
        self.file.seek(self.base + len(self.data))
        while more := self.file.read(CHUNK):
            yield more

    def record(self, p: int, keep: bool) -> tuple[bytes, int] | None:
        """Of a record that starts at ``p``: its bytes (its header without ``keep``) and where the next starts; None if there is none."""
        return self._packed(p, keep) if self.packed else self._plain(p, keep)

    def _plain(self, p: int, keep: bool) -> tuple[bytes, int] | None:
        end = self.data.find(b"\r\n\r\n", p, p + MAX_HEADER)
        length = LENGTH.search(self.data, p, end + 2) if end >= 0 and self.data.startswith(MAGIC, p) else None
        if length is None:
            return None
        to = end + 8 + int(length[1])
        if not keep:
            return self.data[p : end + 4], to
        if to > len(self.data):
            self.file.seek(self.base + len(self.data))
            self.data += self.file.read(to - len(self.data))
        return self.data[p:to], to

    def _packed(self, p: int, keep: bool) -> tuple[bytes, int] | None:
        unpack = zlib.decompressobj(31)
        out, head, used = [], b"", 0
        try:
            for chunk in self._from(p):
                used += len(chunk)
                more = unpack.decompress(chunk)
                if len(head) < MAX_HEADER:
                    head += more[:MAX_HEADER]
                if len(head) >= len(MAGIC) and not head.startswith(MAGIC):
                    return None
                if keep:
                    out.append(more)
                if unpack.eof:
                    if not head.startswith(MAGIC):
                        return None
                    return b"".join(out) if keep else head, p + used - len(unpack.unused_data)
        except zlib.error:
            pass
        return None


def _splits(manifest: DataFrame, split_bytes: int) -> DataFrame:
    last = F.floor((F.col("size") - 1) / F.lit(split_bytes)).cast("long")
    return manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("split"))


def candidates(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every place of the archives that looks like a record: ``path``, ``size``, ``split``, ``offset``, ``successor``, ``leaves``.

    ``leaves`` is the first offset beyond the split that following successors from here gives, null where one of
    them within the split is no candidate. Magic within a payload is a candidate too.
    """
    splits = _splits(manifest, split_bytes)
    n = max(1, splits.count())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_fs(row["path"])
                start, end = row["split"] * split_bytes, min(row["size"], (row["split"] + 1) * split_bytes)
                with fs.open_input_file(at) as file:
                    part = Bytes(file, start, end - start + MAX_HEADER)
                    found = [(start + p, start + after[1]) for p in part.candidates(end - start) if (after := part.record(p, keep=False))]
                leaves: dict[int, int | None] = {}
                for offset, to in reversed(found):
                    leaves[offset] = to if to >= end else leaves.get(to)
                yield pa.RecordBatch.from_pydict({"path": pa.array([row["path"]] * len(found), pa.string()), "size": pa.array([row["size"]] * len(found), pa.int64()), "split": pa.array([row["split"]] * len(found), pa.int64()), "offset": pa.array([o for o, _ in found], pa.int64()), "successor": pa.array([s for _, s in found], pa.int64()), "leaves": pa.array([leaves[o] for o, _ in found], pa.int64())})

    return splits.repartition(n).mapInArrow(scan, "path string, size long, split long, offset long, successor long, leaves long")


def entries(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The first true record of each split that has one: ``path``, ``size``, ``split``, ``offset``.

    Pointer jumping from the start of each file: in round k the reached offsets and those 2**k splits on are joined,
    then the pointers are squared. A candidate that no chain from offset 0 reaches is dropped.
    """
    most = manifest.selectExpr("max(size)").first()[0] or 0
    rounds = max(0, math.ceil(math.log2(max(1, math.ceil(most / split_bytes)))))
    found = checkpointed(candidates(manifest, split_bytes))
    hop = found.select("path", "offset", F.col("leaves").alias("to")).where("to is not null")
    reached = manifest.where("size > 0").select("path", F.lit(0).cast("long").alias("offset"))
    for k in range(rounds):
        reached = checkpointed(reached.unionByName(reached.join(hop, ["path", "offset"]).select("path", F.col("to").alias("offset"))))
        if k + 1 < rounds:
            then = hop.select("path", F.col("offset").alias("to"), F.col("to").alias("next"))
            hop = checkpointed(hop.join(then, ["path", "to"]).select("path", "offset", F.col("next").alias("to")))
    # a chain enters a split once; what is reached beyond the file's end, or where no candidate is, the readers check
    firsts = reached.join(manifest.select("path", "size"), "path").where("offset < size")
    return firsts.select("path", "size", F.floor(F.col("offset") / F.lit(split_bytes)).cast("long").alias("split"), "offset")


READ = "page_id long, url string, record_type string, refers_to long, digest string, full_bytes long, payload binary"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Response and revisit records of archives, read in splits from verified boundaries.

    ``payload`` is null for a revisit; ``digest`` and ``full_bytes`` are as its headers say. A chain that breaks, or
    ends elsewhere than the file does, raises: that archive is damaged.
    """
    starts = entries(manifest, split_bytes)
    starts = checkpointed(starts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_fs(row["path"])
                begin, end = row["offset"], min(row["size"], (row["split"] + 1) * split_bytes)
                with fs.open_input_file(at) as file:
                    part = Bytes(file, begin, end - begin + MAX_HEADER)
                    offset, rows, held = begin, [], 0
                    while offset < end:
                        place = part.record(offset - begin, keep=True)
                        if place is None or begin + place[1] > row["size"]:
                            raise ValueError(f"{row['path']}: no record at {offset}")
                        head, _, block = place[0].partition(b"\r\n\r\n")
                        fields = _fields(head)
                        if not block.endswith(b"\r\n\r\n") or len(block) - 4 != int(fields["content-length"]):
                            raise ValueError(f"{row['path']}: the record at {offset} does not end with its length")
                        if fields["warc-type"] in ("response", "revisit"):
                            http, _, payload = block[:-4].partition(b"\r\n\r\n")
                            revisit = fields["warc-type"] == "revisit"
                            number = lambda k, f=fields: None if f.get(k, "None") == "None" else int(f[k])
                            rows.append((number("x-page-id"), fields.get("warc-target-uri"), fields["warc-type"], number("x-refers-to-page-id"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(_fields(http)["content-length"]), None if revisit else payload))
                            held += len(payload)
                        offset = begin + place[1]
                        if held > SPLIT_BYTES:
                            yield _read_batch(rows)
                            rows, held = [], 0
                    yield _read_batch(rows)

    return starts.repartition(max(1, starts.count())).mapInArrow(read, READ)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "digest", "full_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)
