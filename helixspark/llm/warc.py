"""WARC archives: a writer with revisit records, and a splittable reader that finds records by scanning for gzip magic."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm._common import new_path, table

#: Payloads of at least so many bytes are stored once; bytes of an archive that one task owns; bytes of one read.
LEAST_REVISIT, SPLIT, READ = 1000, 8 << 20, 1 << 20
#: An empty gzip member parts records. It is the line separator of Spark's text writer, whose committer survives lost tasks.
GAP = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: bytes, size: int, refers_to: int | None) -> bytes:
    """One gzip member with one WARC record; a revisit keeps the HTTP header with the payload's length, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    name = "" if page_id is None else str(page_id)
    uri = "" if url is None else url.encode("unicode_escape").decode("ascii")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}\r\n"
    if kind == "revisit":
        head += f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n"
    raw = f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse(raw: bytes) -> tuple | None:
    """Fields of a decoded record, or None if it isn't a whole WARC record of a response or revisit.

    Its lengths must hold, and its digest where it states one by SHA-1; else the digest is computed. Other kinds of records
    (warcinfo, request, metadata) hold no page. An id that isn't ``<urn:page:N>`` gives no page id; a block without an HTTP
    header is the payload itself.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    fields = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines[1:])}
    stated_length, kind = fields.get("content-length", ""), fields.get("warc-type", "")
    n = int(stated_length) if stated_length.isdigit() else -1
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n" or kind not in ("response", "revisit"):
        return None
    http, payload = b"", rest[:n]
    if payload.startswith(b"HTTP/"):
        http, _, payload = payload.partition(b"\r\n\r\n")
    header = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    # A revisit keeps the length of the payload that it leaves out.
    size = int(header["content-length"]) if kind == "revisit" and header.get("content-length", "").isdigit() else len(payload)
    method, _, code = fields.get("warc-payload-digest", "").partition(":")
    stated = base64.b32decode(code.upper()).hex() if method.lower() == "sha1" and len(code) == 32 else None
    if kind == "response":
        found = hashlib.sha1(payload).hexdigest()
        if stated not in (None, found):
            raise ValueError(f"{fields.get('warc-record-id')}: the payload does not match its digest")
        stated = found
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    uri = fields.get("warc-target-uri", "")
    return page(fields.get("warc-record-id")), uri.encode().decode("unicode_escape") if uri.isascii() else uri, size, stated, kind, page(fields.get("warc-refers-to")), payload if kind == "response" else None


class Stream:
    """Bytes of an open file from any offset, kept in a window that follows the reader."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.window = file, size, 0, b""

    def get(self, a: int, b: int) -> bytes:
        b = min(b, self.size)
        if a < self.at or b > self.at + len(self.window):
            self.at, self.window = a, self.file.read_at(max(b - a, min(READ, self.size - a)), a)
        return self.window[a - self.at : b - self.at]


def member(stream: Stream, at: int) -> tuple[bytes, int] | None:
    """The decoded gzip member that starts at a place and its end, or None if none does.

    The header must decode, and the first bytes must be a WARC record's (an empty member parts two records).
    """
    unpack, out, place = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and place < stream.size:
            part = stream.get(place, place + (1 << 16))
            out.append(unpack.decompress(part))
            place += len(part)
            if len(out) == 1 and out[0][:5] != b"WARC/"[: len(out[0])]:
                return None
    except zlib.error:
        return None
    return (b"".join(out), place - len(unpack.unused_data)) if unpack.eof else None


def owned(stream: Stream, start: int, end: int) -> Iterator[tuple]:
    """Records whose first byte lies in [start, end), read to their ends even beyond it."""
    at = start
    while at < end:
        # The magic may straddle two reads, so the last two bytes are looked at again.
        part = stream.get(at, min(at + (1 << 16), end) + 2)
        k = part.find(MAGIC)
        if k < 0:
            at += max(1, len(part) - 2)
            continue
        at += k
        if at >= end:
            return
        got = member(stream, at)
        fields = parse(got[0]) if got and got[0] else None
        if fields:
            yield fields
        # The bytes of a valid member are its own; a false magic is passed by.
        at = got[1] if got and (fields or not got[0]) else at + 1


def write_warc(pages: DataFrame, path: str) -> None:
    """Write a record for each row of ``page_id, url, html`` (null html: empty) to ``path``, in any store Spark writes to.

    Of equal payloads of at least 1000 bytes, the rows with the largest page_id are responses, the others revisits that
    refer to it; smaller payloads are all responses. Repeated rows each give a record. Rows with a null page_id refer to
    others, but nothing refers to them.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    large = F.col("size") >= LEAST_REVISIT
    # Small payloads get keys that match nothing and, unlike null, spread over all tasks.
    rows = rows.withColumn("same", F.when(large, F.col("digest")).otherwise(F.unhex(F.hex(F.xxhash64("page_id", "digest")))))
    first = rows.where(large & F.col("page_id").isNotNull()).groupBy("same").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("same", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, payload, digest, size, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                again = kept is not None and kept != page_id
                out.append(record("revisit" if again else "response", page_id, url, b"" if again else payload, digest, size, kept if again else None))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    joined = rows.join(first, "same", "left").select("page_id", "url", "payload", "digest", "size", "kept")
    members = joined.mapInArrow(run, "member binary").select(F.col("member").cast("string"))
    members.write.option("lineSep", GAP.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def read_warc(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of each record under ``path``.

    Tasks own byte ranges of the archives; a record belongs to the task in whose range it starts. Byte ranges are opened
    through Arrow's file systems (local, HDFS, S3 and others by their URI). An empty archive gives no rows.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    listing = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    files = [(x.getPath().toString(), x.getLen()) for x in listing if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    ranges = [(f, n, a, min(a + split, n)) for f, n in files for a in range(0, n, split)]
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        for b in batches:
            for uri, size, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # Hadoop writes file:/x for what other libraries call file:///x.
                store, name = fs.FileSystem.from_uri(uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                rows, held = [], 0
                with store.open_input_file(name) as f:
                    for fields in owned(Stream(f, size), start, end):
                        rows.append(fields)
                        held += fields[2] + 200
                        if held > READ * 4:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    some = spark.createDataFrame(ranges, "uri string, size bigint, start bigint, stop bigint")
    return some.repartition(max(1, len(ranges))).mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
SQL = {
    "op6_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
     f as (select payload_digest, max(page_id) as kept from p where payload_bytes >= 1000 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when kept <> page_id then 'revisit' else 'response' end as record_type,
       case when kept <> page_id then kept end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 1000
"""
}
