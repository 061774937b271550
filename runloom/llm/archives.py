"""WARC: a converter from legacy ARC archives, with writers and readers of both on shared storage.

ARC files (versions 1 and 2) start with a version block, whose first line declares its length and whose second the
version; each record is a header line of version-specific fields, the last of which is the declared length of what follows.
The converter parses these and synthesises equivalent WARC 1.1 records: a name-based record id, an ISO timestamp from the
14-digit date, type ``response`` or ``revisit``, and block and payload digests (upper-case base32 SHA-1). Among records of
equal payloads of ``least`` bytes or more, the one of the largest page id stays a response and the others become revisits that refer to it.

Archives are written by Spark as gzipped text files whose line separator ends a record, so every file is a whole archive
and retried tasks replace their files. Files hold at most ``RECORDS`` records and are read back by declared lengths.

Defined results: a null html is an empty payload; a null url is written as "-"; white space and non-ASCII characters in
urls are percent-encoded; null page ids are carried, and rank lowest; rows that repeat the largest page id of a payload are all
responses; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, new_path, ready

RECORDS = 1000
LEVEL = "THREE"  # of gzip: about half the work of the default level
DATE = "20240101000000"  # pages carry no date of their own
# Fields of an ARC header line by version.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
RECORD = "page_id bigint, url string, date string, mime string, payload binary, digest string, record_id string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None) -> str:
    return quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "-"


def arc_header(version: str, url: str, date: str, mime: str, length: int, payload: bytes = b"") -> bytes:
    known = {"url": url, "ip": "0.0.0.0", "date": date, "type": mime, "status": "200", "length": str(length), "file": "pages.arc", "offset": "0"}
    if version == "2":
        known["checksum"] = digest(payload)
    return " ".join(known.get(f, "-") for f in ARC_FIELDS[version]).encode()


def arc_version_block(version: str) -> bytes:
    body = f"{version} 0 pages\n{'URL IP-address Archive-date Content-type Archive-length' if version == '1' else 'URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length'}\n"
    return f"filedesc://pages.arc 0.0.0.0 {DATE} text/plain {len(body)}\n{body}".encode()


def to_arc(pages: DataFrame, path: str, version: str = "1", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes pages as ARC files."""
    ready(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                out = []
                for i, u, body in zip(*(c.to_pylist() for c in batch.slice(a, 64).columns)):
                    if seen % (RECORDS - 1) == 0:  # the first record of each file
                        out.append(arc_version_block(version))
                    seen += 1
                    body = body or b""
                    ident = "" if i is None else f"X-Page-Id: {i}\r\n"
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ident}Content-Length: {len(body)}\r\n\r\n".encode() + body
                    out.append(arc_header(version, safe_url(u), DATE, "text/html", len(http), body) + b"\n" + http)
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], ["value"])

    text = rows.mapInArrow(run, "value string")
    text.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", LEVEL).option("maxRecordsPerFile", RECORDS).text(path)


class Stream:
    """Bytes of a gzipped or plain archive, inflated as they are read."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.start = memoryview(data), 0, bytearray(), 0
        self.gz = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        chunk = self.data[self.at : self.at + (1 << 18)]
        self.at += len(chunk)
        if not len(chunk):
            return False
        if self.start > 1 << 22:
            del self.held[: self.start]
            self.start = 0
        while len(chunk):
            self.held += self.gz.decompress(chunk) if self.gz else chunk
            chunk = b""
            if self.gz and self.gz.eof and self.gz.unused_data:  # a member for each record
                chunk, self.gz = self.gz.unused_data, zlib.decompressobj(31)
        return True

    def until(self, end: bytes) -> bytes | None:
        """What comes before ``end``, which is passed; None at the end of the archive."""
        look = self.start
        while (at := self.held.find(end, look)) < 0:
            back = len(self.held) - self.start
            if not self._more():
                return None
            look = max(self.start, self.start + back - len(end))
        out = bytes(self.held[self.start : at])
        self.start = at + len(end)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.start < n and self._more():
            pass
        out = bytes(self.held[self.start : self.start + n])
        self.start += len(out)
        return out


def headers_of(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


def arc_records(data: bytes) -> Iterator[tuple]:
    """(page id, url, date, mime, payload, digest, record id) of each record of an ARC archive."""
    s, fields, first = Stream(data), ARC_FIELDS["1"], True
    while (line := s.until(b"\n")) is not None:
        if not line.strip():
            continue
        if first or line.startswith(b"filedesc://"):
            first = False
            body = s.take(int(line.split()[-1]))
            fields = ARC_FIELDS[body.split(None, 1)[0].decode()]
            continue
        head = dict(zip(fields, line.decode().rsplit(" ", len(fields) - 1)))
        block = s.take(int(head["length"]))
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep or not http.startswith(b"HTTP/"):
            http, payload = b"", block
        ident = headers_of(http).get("x-page-id")
        dg = digest(payload)
        name = f"{head['url']} {head['date']} {ident} {dg}"
        record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}"
        yield int(ident) if ident else None, head["url"], head["date"], head["type"], payload, dg, record_id


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files in a folder."""
    return _read(spark, path, arc_records, RECORD)


def _read(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    ready(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for r in parse(batch.column(0)[k].as_py()):
                    rows.append(r)
                    held += len(r[4] or b"") if len(r) > 4 and isinstance(r[4], bytes) else 100
                    if held > 1 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    return files.mapInArrow(run, schema)


_KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split() for f in schema.split(",")]
    cols = [pa.array([r[j] for r in rows], _KINDS[kind]) for j, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(cols, [name for name, _ in fields])


def warc_record(page_id, url, date, mime, payload, dg, record_id, refers_to) -> bytes:
    """One WARC 1.1 record without the two line ends that close it."""
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    ident = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\n{ident}Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{dg}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def warc_records(data: bytes) -> Iterator[tuple]:
    """(page id, record type, record id, id referred to, payload of a response, payload bytes, payload digest) of each record."""
    s = Stream(data)
    while (head := s.until(b"\r\n\r\n")) is not None:
        if not head.strip():
            continue
        h = headers_of(head.lstrip(b"\r\n"))
        block = s.take(int(h["content-length"]))
        s.take(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        inner = headers_of(http)
        kind, ident, dg = h["warc-type"], inner.get("x-page-id"), h["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and digest(payload) != dg:
            raise ValueError(f"payload of {h['warc-record-id']} is damaged")
        yield (
            int(ident) if ident else None, kind, h["warc-record-id"].strip("<>"), h.get("warc-refers-to", "").strip("<>") or None,
            payload if kind == "response" else None, int(inner["content-length"]), dg,
        )


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """Writes the records of the ARC files in a folder as WARC files."""
    records = read_arc(spark, arc_path)
    heads = materialise(records.select("page_id", "digest", F.length("payload").cast("bigint").alias("n"), "record_id"), "records")
    heads = heads.where(f"n >= {least}")
    best = heads.groupBy(F.col("digest").alias("dg"), F.col("n").alias("size")).agg(F.max("page_id").alias("top")).where("top is not null")
    top = best.join(heads, (F.col("dg") == F.col("digest")) & (F.col("size") == F.col("n")) & (F.col("top") == F.col("page_id")))
    top = top.groupBy("dg", "size", "top").agg(F.min("record_id").alias("target"))
    both = records.join(top, (F.col("digest") == F.col("dg")) & (F.length("payload") == F.col("size")), "left")
    refers = F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("target"))
    both = both.select("page_id", "url", "date", "mime", "payload", "digest", records["record_id"], refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = zip(*(c.to_pylist() for c in batch.slice(a, 64).columns))
                yield pa.RecordBatch.from_arrays([pa.array([warc_record(*r) for r in rows], pa.binary()).cast(pa.string())], ["value"])

    text = both.mapInArrow(run, "value string")
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", LEVEL).option("maxRecordsPerFile", RECORDS).text(warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files in a folder; digests of responses are checked against their payloads."""
    return _read(
        spark, path, warc_records,
        "page_id bigint, record_type string, record_id string, refers_to_id string, payload binary, payload_bytes bigint, payload_digest string",
    )


def archive(pages: DataFrame, least: int = 0, version: str = "1", **columns) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    to_arc(pages, arc, version, **columns)
    convert(spark, arc, warc, least)
    back = materialise(read_warc(spark, warc).drop("payload"), "archive")
    targets = back.where("record_type = 'response'").groupBy(F.col("record_id").alias("id")).agg(F.max("page_id").alias("refers_to"))
    out = back.join(targets, F.col("refers_to_id") == F.col("id"), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
