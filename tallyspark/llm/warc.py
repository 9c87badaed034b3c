"""Operator 7, WARC archives in Zstandard: writer and reader.

An archive begins with a skippable frame that holds its dictionary, then comes one frame per record. Each
task writes archives of bounded size into the shared folder under names of its own attempt; the written list
of finished archives names those that count, so retried or lost tasks leave no record twice. The reader
takes one archive per task, streams it frame by frame, and fails on a wrong version, length, end, digest or
a frame that holds more or less than one record.

Of pages with equal payloads of at least ``least`` bytes only the one with the largest id carries it; the
others are revisits that refer to it. Equality is judged by SHA-1 and length, on small rows.

Defined cases: null html is an empty payload; rows that share the largest id of their payload all carry it;
a null id is below any other; a null url is written as an empty field; line ends in urls are written
percent-encoded; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import new_path, saved

#: Fixed values of the format.
VERSION, SKIPPABLE, FRAME = b"WARC/1.1", 0x184D2A5D, b"\x28\xb5\x2f\xfd"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive, of a dictionary, and of the first records that train it.
ARCHIVE_BYTES, DICT_BYTES, TRAIN_BYTES = 64 << 20, 16 << 10, 1 << 20


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit without payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}:{digest}>"), ("WARC-Date", DATE),
            ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}")]
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the first sample's bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return next((s[:DICT_BYTES] for s in samples if len(s) >= 8), b"")


class ArchiveWriter:
    """Appends records to archives under ``folder``; ``done`` lists (path, bytes, records)."""

    def __init__(self, folder: str):
        self.uri = folder
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.waiting, self.size, self.out, self.done = [], 0, None, []

    def _begin(self) -> None:
        raw = _dictionary(self.waiting)
        self.codec = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.bytes, self.records = f"{self.uri}/{name}", 0, 0
        self.out = self.fs.open_output_stream(f"{self.folder}/{name}", compression=None)
        self.bytes += self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        for r in self.waiting:
            self._put(r)
        self.waiting, self.size = [], 0

    def _put(self, record: bytes) -> None:
        self.bytes += self.out.write(self.codec.compress(record))
        self.records += 1
        if self.bytes >= ARCHIVE_BYTES:
            self.close()

    def write(self, record: bytes) -> None:
        if self.out is not None:
            self._put(record)
            return
        self.waiting.append(record)
        self.size += len(record)
        if self.size >= TRAIN_BYTES:
            self._begin()

    def close(self) -> None:
        if self.out is None and self.waiting:
            self._begin()
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.bytes, self.records))
            self.out = None


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records(page_id, url, html, digest, refers_to)``; the list ``path, bytes, records`` of the archives."""

    def run(batches):
        w = ArchiveWriter(folder)
        for b in batches:
            for page, url, html, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                w.write(_record(page, url, (html or "").encode(), digest, refers))
        w.close()
        if w.done:
            path, size, n = zip(*w.done)
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["path", "bytes", "records"])

    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return saved(records.mapInArrow(run, "path string, bytes long, records long"), "warc-list")


def frames(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The content of each frame behind the leading dictionary frame of a ``.warc.zst`` stream."""
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("archive without a leading skippable frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("archive does not begin with a dictionary frame")
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError("dictionary frame is cut off")
    if raw[:4] == FRAME:  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    data = b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                return
        one, parts = codec.decompressobj(), []
        while not one.eof:
            if not data:
                data = stream.read(chunk)
                if not data:
                    raise ValueError("last frame is cut off")
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        yield b"".join(parts)


def parse(record: bytes) -> dict:
    """Fields of one record, its headers, lengths and digests checked."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0].encode() != VERSION:
        raise ValueError(f"not a record of {VERSION.decode()}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"record without {name}")
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("record length does not match its header")
    if fields["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError("block digest does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).partition(":")[2])
    digest = fields["warc-payload-digest"].partition(":")[2]
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload does not match its length or digest")
    if kind == "revisit" and payload:
        raise ValueError("revisit with a payload")
    url = fields["warc-target-uri"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    ids = [x[1:-1].split(":")[2] if x else "None" for x in (fields["warc-record-id"], fields.get("warc-refers-to", ""))]
    page, refers = (None if x == "None" else int(x) for x in ids)
    return {"page_id": page, "url": url, "payload": payload if kind == "response" else None, "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": refers}


def read_archives(listed: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives in ``listed(path)``, one task per archive."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    rows, size = [], 0
                    for record in frames(stream):
                        r = parse(record)
                        if not with_payload:
                            r["payload"] = None
                        rows.append(r)
                        size += len(r["payload"] or b"") + 200
                        if size > 4 << 20:
                            yield _batch(rows, names, types)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, names, types)

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return listed.select("path").repartition(max(1, listed.count())).mapInArrow(run, schema)


def _batch(rows: list[dict], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages(page_id, url, html)`` with ``digest`` and, for revisits, ``refers_to``.

    Only digests that occur more than once are joined back; their rows are counted before the shuffle."""
    html = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html).alias("digest"))
    small = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("same"), F.octet_length("html").alias("n"))
    first = (small.where(F.col("n") >= least).groupBy("same").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n_rows"))
             .where("n_rows > 1 and largest is not null").drop("n_rows"))
    d = d.join(first, d["digest"] == first["same"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")), F.col("largest"))
    return d.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Write all ``pages`` to archives in the shared folder; the list of archives."""
    return write_archives(plan_records(pages, least), folder or new_path(pages.sparkSession, "warc"))


def query(spark, sf_dir: str) -> DataFrame:
    listed = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(listed, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
