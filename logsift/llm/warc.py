"""Legacy ARC archives to WARC, and back to rows.

``write_arc`` writes pages as gzipped ARC files of version 1 or 2, ``convert`` reads
ARC files and writes WARC 1.1 files, ``read_warc`` reads those. Files are written
and read by Spark (text writer, binaryFile reader) in any store it knows; each
holds some megabytes, so a task never holds more than one of them.

ARC: a version block (``filedesc://``) names the version and the fields of the
header lines that follow it; each record is a header line, the declared number
of bytes and a newline. The converter reads fields by their names in that
definition and never searches contents for boundaries. A converted record gets
an id (a UUID set by its page and payload digest), an ISO timestamp, payload
and block digests (SHA-1, base32) and a type: of records with equal payloads
of at least ``min_bytes`` bytes the one with the smallest page id is a response,
the others are revisits of it without payload; smaller ones are responses.

Null payloads are empty payloads. A null URL becomes ``unknown:``; white space,
controls and non-ASCII in URLs are percent-encoded, as header lines are split
at blanks. Records with a null page id revisit the smallest id that shares
their payload, or are responses if there is none. Repeated rows (equal id
and payload) are each responses if theirs is the smallest id.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .blocks import written

RUN_BYTES = 1 << 20   # records written as one row of the text writer
RUNS_PER_FILE = 8
#: Fixed values of the formats.
ARC_FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
              2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _http(page_id, payload: bytes) -> bytes:
    named = "-" if page_id is None else str(page_id)
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {named}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()


def _line(version: int, url: str, date: str, kind: str, name: str, size: int) -> bytes:
    given = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-",
             "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(size)}
    return " ".join(given[f] for f in ARC_FIELDS[version]).encode() + b"\n"


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 logsift\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return _line(version, f"filedesc://{name}", date, "text/plain", name, len(body)) + body


def _runs(records: Iterator[bytes], joint: bytes, first) -> Iterator[pa.RecordBatch]:
    """Records joined to rows of about RUN_BYTES; ``first(k)`` starts the k-th row."""
    have, size, k = [], 0, 0
    for r in records:
        if not have:
            have, size, k = [first(k)], 0, k + 1
        have.append(r)
        size += len(r)
        if size >= RUN_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([joint.join(have)], pa.binary())], ["value"])
            have = []
    if have:
        yield pa.RecordBatch.from_arrays([pa.array([joint.join(have)], pa.binary())], ["value"])


def _save(runs: DataFrame, path: str, separator: str) -> str:
    (runs.select(F.col("value").cast("string")).write.mode("overwrite").option("lineSep", separator).option("compression", "gzip")
     .option("maxRecordsPerFile", RUNS_PER_FILE).text(path))
    return path


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "20240101000000") -> str:
    """One record per row; every task writes files of one version, tasks take turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        version = 1 + task % 2

        def records():
            for b in batches:
                for i in range(b.num_rows):
                    page, address, body = (c[i].as_py() for c in b.columns)
                    body = (body or "").encode()
                    block = _http(page, body) + body
                    address = urllib.parse.quote(address or "unknown:", safe="%!\"#$&'()*+,/:;<=>?@[\\]^`{|}~")
                    yield _line(version, address, date, "text/html", "-", len(block)) + block
        yield from _runs(records(), b"\n", lambda k: version_block(version, f"{task}-{k}.arc", date))

    return _save(pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(payload).cast("string")).mapInArrow(run, "value binary"), path, "\n")


def _unzip(content: bytes) -> bytes:
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and contents of each record, version blocks aside."""
    at, fields = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("latin-1")
        if not line:
            at = end + 1
            continue
        size = int(line[line.rindex(" ") + 1:])
        body = data[end + 1:end + 1 + size]
        if len(body) < size:
            raise ValueError(f"record at {at} ends early")
        at = end + 1 + size
        if line.startswith("filedesc://"):
            version, _, definition = body.partition(b"\n")
            if version[:1] not in (b"1", b"2"):
                raise ValueError(f"ARC version {version[:20]!r}")
            fields = definition.split(b"\n")[0].decode().split(" ")
            continue
        if fields is None:
            raise ValueError("no version block")
        yield dict(zip(fields, line.split(" "), strict=True)), body


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the records in ARC files."""
    names = ["page_id", "url", "ip", "date", "mime", "head", "payload", "size", "digest"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
    for b in batches:
        for content in b.column("content"):
            rows, size = [], 0
            for f, body in parse_arc(_unzip(content.as_py())):
                head, _, payload = body.partition(b"\r\n\r\n")
                page = next((x[11:].decode() for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id: ")), "-")
                d = f["Archive-date"]
                rows.append((None if page == "-" else int(page), f["URL"], f["IP-address"], f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
                             f["Content-type"], head + b"\r\n\r\n", payload, len(payload), digest(payload)))
                size += len(payload)
                if size >= RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def record_id(page, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {payload_digest}')}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for b in batches:
            for i in range(b.num_rows):
                r = {k: c[i].as_py() for k, c in zip(b.schema.names, b.columns, strict=True)}
                revisit = r["refers_to"] is not None
                block = r["head"] if revisit else r["head"] + r["payload"]
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(r["page_id"], r["digest"])),
                          ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
                          ("WARC-Payload-Digest", "sha1:" + r["digest"]), ("WARC-Block-Digest", "sha1:" + digest(block)),
                          ("Content-Type", "application/http;msgtype=response")]
                if revisit:
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(r["refers_to"], r["digest"])),
                               ("X-Refers-To-Page-Id", str(r["refers_to"]))]
                yield _record(fields, block)

    info = b"software: logsift\r\nformat: WARC File Format 1.1\r\n"
    yield from _runs(records(), b"\r\n\r\n", lambda k: _record(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", str(k))), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info))


def convert(spark, arc_path: str, warc_path: str, min_bytes: int = 0) -> str:
    """ARC files to WARC files."""
    rows = spark.read.format("binaryFile").load(arc_path).select("content").mapInArrow(
        _converted, "page_id long, url string, ip string, date string, mime string, head binary, payload binary, size long, digest string")
    first = written(rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first")), "digests")
    marked = rows.join(first, "digest", "left").withColumn(
        "refers_to", F.when((F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    return _save(marked.drop("first").mapInArrow(_warc, "value binary"), warc_path, "\r\n\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        if data[at:at + 10] != b"WARC/1.1\r\n":
            raise ValueError(f"no record at {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at + 10:end].decode().split("\r\n"))
        size = int(fields["Content-Length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record", "url", "date"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        for content in b.column("content"):
            rows = []
            for f, block in parse_warc(_unzip(content.as_py())):
                if f["WARC-Type"] not in ("response", "revisit"):
                    continue
                if "sha1:" + digest(block) != f["WARC-Block-Digest"]:
                    raise ValueError(f"damaged record {f['WARC-Record-ID']}")
                head, _, payload = block.partition(b"\r\n\r\n")
                http = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:])
                known = f["WARC-Payload-Digest"].removeprefix("sha1:")
                if f["WARC-Type"] == "response" and (digest(payload) != known or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"damaged payload {f['WARC-Record-ID']}")
                page, at = http.get("X-Page-Id", "-"), f.get("X-Refers-To-Page-Id")
                rows.append((None if page == "-" else int(page), int(http["Content-Length"]), known, f["WARC-Type"], at and int(at),
                             f["WARC-Record-ID"], f.get("WARC-Refers-To"), f["WARC-Target-URI"], f["WARC-Date"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_warc(spark, path: str) -> DataFrame:
    """A row per response or revisit; digests are checked against the contents."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, "
               "refers_to_record string, url string, date string")


def archive(pages: DataFrame, min_bytes: int = 0, **columns) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back."""
    spark, name = pages.sparkSession, uuid.uuid4().hex
    arc = write_arc(pages, scratch_path(spark, "archives", f"arc-{name}"), **columns)
    return read_warc(spark, convert(spark, arc, scratch_path(spark, "archives", f"warc-{name}"), min_bytes))


def query(spark, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date").drop("url", "date", "record_id")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(p.h, (i // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN f USING (h)
"""
