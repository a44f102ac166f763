"""Legacy ARC archives as WARC: parsed by version, given identifiers, timestamps, types and digests, and written with revisits.

ARC: a version block `filedesc://` (version 1 or 2, and the names of its URL-record fields), then records of one header line,
as many bytes as its last field declares, and a line end. Version 1 has URL, IP, date, type, length; version 2 has also result
code, checksum, location, offset and file name before the length. A block of type other than plain text bytes begins with an
HTTP head, as crawlers wrote it.
WARC: version 1.1, one zstandard frame a record; a file ends in an empty skippable frame, whose bytes are the text writer's
line end. A response's payload is the HTTP body; a revisit has the HTTP head alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.base import scratch

#: Bytes of records from which an archive is complete.
ARCHIVE_BYTES = 16_000_000
SKIP = "P*M\x18\0\0\0\0"
SPACE = uuid.UUID("6f0d5a3c-52a0-4b58-9c43-0f6a5f3f7f11")
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    version: int = 1

    @property
    def http(self) -> bool:
        return self.block[:5] == b"HTTP/"

    def parts(self) -> tuple[bytes, bytes]:
        """The HTTP head, with its blank line, and the body; no head if the block isn't HTTP."""
        if not self.http:
            return b"", self.block
        for mark in (b"\r\n\r\n", b"\n\n"):
            if (at := self.block.find(mark)) >= 0:
                return self.block[: at + len(mark)], self.block[at + len(mark) :]
        return self.block, b""

    def header(self, name: str) -> str | None:
        m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", self.parts()[0])
        return m[1].decode("utf-8", "replace") if m else None


def arc_version(version: int, date: str, name: str = "pages.arc") -> bytes:
    block = f"{version} 0 weftline\n{' '.join(FIELDS[version])}\n\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(block)}", 2: f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(block)}"}[version]
    return line.encode() + b"\n" + block + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, ip: str = "0.0.0.0", kind: str = "text/html", offset: int = 0, name: str = "pages.arc") -> bytes:
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "unknown:"
    middle = {1: "", 2: f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}"}[version]
    return f"{url} {ip} {date} {kind}{middle} {len(block)}\n".encode() + block + b"\n"


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records behind the version block, by the fields that it names and the lengths that they declare."""
    at, names, version = 0, FIELDS[1], 1
    while at < len(content):
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].strip()
        at = end + 1 if end >= 0 else len(content)
        if not line:
            continue
        values = line.decode("utf-8", "replace").split(" ")
        if not values[-1].isdigit() or len(values) < 5:
            raise ValueError(f"not an ARC header line: {line[:80]!r}")
        block = content[at : at + int(values[-1])]
        if len(block) < int(values[-1]):
            raise ValueError("an ARC record ends before its declared length")
        at += len(block)
        if line.startswith(b"filedesc://"):
            told = block.split(b"\n")
            version = int(told[0].split(b" ")[0])
            names = told[1].decode().strip().split(" ") if len(told) > 1 and told[1].strip() else FIELDS[version]
            continue
        if len(values) != len(names):  # a space within the URL or the type: the ends are certain
            extra = len(values) - len(names)
            if extra < 0:
                raise ValueError(f"an ARC header line lacks fields: {line[:80]!r}")
            values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]
        yield ArcRecord(dict(zip(names, values)), block, version)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    """Of the 14 digits of an ARC date, or as many as there are; the epoch if they are none."""
    try:
        return datetime.strptime((date + "00000101000000"[len(date) :])[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(url: str, date: str, digest: str, mark: str) -> str:
    """The same for the same record, so that a task that runs again writes the same archive."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{url} {date} {digest} {mark}')}>"


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def dump(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in [*self.headers.items(), ("Content-Length", str(len(self.block)))])
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + self.block + b"\r\n\r\n"


def to_warc(arc: ArcRecord, original: tuple[str, str, str] | None = None) -> WarcRecord:
    """original: id, URI and date of the response with the same payload, for a revisit."""
    head, body = arc.parts()
    digest, url, date = base32_sha1(body), arc.fields["URL"], warc_date(arc.fields["Archive-date"])
    block = head if original else arc.block
    out = {"WARC-Type": "revisit" if original else "response" if arc.http else "resource", "WARC-Record-ID": record_id(url, date, digest, arc.header("X-Page-Id") or ""), "WARC-Date": date, "WARC-Target-URI": url, "WARC-IP-Address": arc.fields["IP-address"]}
    out |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http; msgtype=response" if arc.http else arc.fields["Content-type"]}
    if original:
        out |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": original[0], "WARC-Refers-To-Target-URI": original[1], "WARC-Refers-To-Date": original[2]}
    return WarcRecord(out, block)


def read_warc(content: bytes) -> Iterator[WarcRecord]:
    """Records of an archive, by their declared lengths; zstandard frames or plain."""
    if content[:4] == b"\x28\xb5\x2f\xfd":
        content = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers.pop("Content-Length"))
        block = content[end + 4 : end + 4 + n]
        if len(block) < n or content[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a WARC record ends before its declared length")
        yield WarcRecord(headers, block)
        at = end + 8 + n


def write_arc(pages: DataFrame, folder: str, version: int = 2, date: str = "20000101000000") -> None:
    """Pages (page_id, url, html) as ARC archives of HTTP responses whose head carries the page_id; null html is empty, a null url is `unknown:`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = arc_version(version, date)
        parts, size = [start], len(start)
        for batch in batches:
            for page_id, url, html in zip(*(x.to_pylist() for x in batch.columns)):
                told = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{told}\r\n".encode() + html
                parts.append(arc_record(version, url or "", date, block, offset=size))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield one(parts)
                    parts, size = [start], len(start)
        if len(parts) > 1:
            yield one(parts)

    def one(parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["value"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    # The text writer ends each archive with its last line end.
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(folder)


RECORD = "page_id long, url string, date string, digest string, payload_bytes long, arc binary, version int"


def arc_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the ARC archives (plain or gzip) of a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        pack = zstandard.ZstdCompressor(level=1)  # what moves to its digest's task is compressed
        for batch in batches:
            for content in batch.column(0):
                content, data = content.as_py(), b""
                while content[:2] == b"\x1f\x8b":
                    unzip = zlib.decompressobj(31)
                    data += unzip.decompress(content) + unzip.flush()
                    content = unzip.unused_data
                rows = []
                for r in read_arc(data or content):
                    body = r.parts()[1]
                    told = r.header("X-Page-Id")
                    rows.append((int(told) if told and told.lstrip("-").isdigit() else None, r.fields["URL"], r.fields["Archive-date"], base32_sha1(body), len(body), pack.compress(" ".join(r.fields.values()).encode() + b"\n" + r.block), r.version))
                    if len(rows) == 500:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(run, RECORD)


def convert(records: DataFrame, folder: str, least: int = 0) -> None:
    """ARC records as WARC archives. Of records with equal payloads of at least `least` bytes, that with the smallest page_id (null is the largest) is the response and the others revisit it."""
    first = records.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "date")).alias("first"), F.count(F.lit(1)).alias("n"))
    # Only digests of more than one record join; a hot one's records are split by adaptive execution.
    joined = records.join(first.filter("n > 1").select("digest", "first"), "digest", "left")
    rows = joined.select("arc", "version", "page_id", "digest", F.col("first.page_id").alias("r_id"), F.col("first.url").alias("r_url"), F.col("first.date").alias("r_date"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, parts, size = zstandard.ZstdCompressor(level=3), [], 0
        for batch in batches:
            for arc, version, page_id, digest, r_id, r_url, r_date in zip(*(x.to_pylist() for x in batch.columns)):
                line, block = zstandard.decompress(arc).split(b"\n", 1)
                names, values = FIELDS[version], line.decode().split(" ")
                values = [" ".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1 :]]
                original = None
                if r_id is not None and page_id != r_id:
                    original = record_id(r_url, warc_date(r_date), digest, str(r_id)), r_url, warc_date(r_date)
                record = to_warc(ArcRecord(dict(zip(names, values)), block, version), original)
                if original:
                    record.headers["X-Refers-To-Page"] = str(r_id)
                if page_id is not None:
                    record.headers["X-Page-Id"] = str(page_id)
                whole = record.dump()
                parts.append(pack.compress(whole))
                size += len(whole)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", SKIP).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and warc_date of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if not content.as_py():
                    continue
                rows = []
                for r in read_warc(content.as_py()):
                    h = r.headers
                    arc = ArcRecord({}, r.block)
                    head, body = arc.parts()
                    told = arc.header("Content-Length") if h["WARC-Type"] == "revisit" else None
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] != "revisit" and base32_sha1(body) != digest:
                        raise ValueError(f"a payload doesn't have its digest: {h['WARC-Record-ID']}")
                    number = lambda k: int(h[k]) if k in h else None
                    rows.append((number("X-Page-Id"), int(told) if told else len(body), digest, h["WARC-Type"], number("X-Refers-To-Page"), h["WARC-Target-URI"], h["WARC-Date"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "warc_date"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string")


def round_trip(pages: DataFrame, least: int = 0, version: int = 2) -> DataFrame:
    """Pages as ARC archives, those as WARC archives, and these read back; both in the shared folder.

    Null html is empty, a null url is `unknown:`. Rows that share the smallest page_id of a payload are all responses; a row
    without page_id revisits one that has it, and is a response where none has. An empty table gives an empty one; other
    columns are ignored.
    """
    folder = scratch(pages.sparkSession)
    write_arc(pages, f"{folder}/arc", version)
    convert(arc_records(pages.sparkSession, f"{folder}/arc"), f"{folder}/warc", least)
    return read_archives(pages.sparkSession, f"{folder}/warc")
