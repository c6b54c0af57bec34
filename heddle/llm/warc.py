"""WARC archives: a writer through Spark's own sink, and a reader that salvages damaged files.

Writing: a record is one gzip member, and the text sink writes runs of members one after another, with an empty
member (zero bytes when unpacked, which the format allows and readers skip) where it would write a line's end. So
archives go to any file system that Spark writes to, and a lost executor's tasks are repeated and committed as
for any other table. Payloads that several rows share are stored once; the other rows become revisit records.

Reading: a record counts when its member's checksum, version line, header, length and digests are right. After a
failed check the reader searches for the next position where a record is right (a member's magic bytes, or a
version line in an uncompressed file), goes on there, and reports the bytes between as a quarantined gap.

Edge cases: a null or empty payload is a payload of no bytes, and rows with it share it like any other; a null
url is written as ``urn:unknown``; a null page id takes no part in choosing the response, and is returned as
null; rows repeating the response's page id are responses as well. An empty table gives an empty archive. A very long
payload is one record, held whole. Further columns are passed on by with_roles(), but for those with a name of its
results, which give way; an archive's record holds none of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.scratch import Scratch

#: Bytes of a run of records from which on it ends, and runs of an archive file, at most. So a file's size is bounded
#: by that of RUNS longest records at worst, and is some RUN * RUNS where records are short.
RUN, RUNS = 1 << 20, 64
DATE = "1970-01-01T00:00:00Z"
#: A gzip member of nothing: header, an empty block, and checksum and length of zero.
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
END = b"\r\n\r\n"


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member, without a time, so that equal records are equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, payload_digest: str | None = None) -> bytes:
    """A response record, or a revisit of ``refers_to`` without the payload but with its digest and length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = f"<urn:page:{page_id}>" if page_id is not None else "<urn:page:unknown>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:unknown"),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest or digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block + END


class Found(NamedTuple):
    """A record (no reason) or a gap (a reason, and nothing but its place)."""

    at: int
    length: int
    reason: str | None
    headers: dict[str, str]
    payload_bytes: int | None
    payload_digest: str | None
    payload: bytes | None


class Damaged(ValueError):
    pass


def parse(data: bytes, at: int = 0, whole: bool = False) -> tuple[Found, int]:
    """The uncompressed record at a position, and where it ends. whole: it must fill the data."""
    if not data.startswith(VERSION, at):
        raise Damaged("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise Damaged("no end of the header")
    try:
        lines = data[at:stop].decode().split("\r\n")
    except UnicodeDecodeError:
        raise Damaged("header not in UTF-8") from None
    if not re.fullmatch(r"WARC/1\.[0-9]+[ \t]*", lines[0]):
        raise Damaged("no version")
    if not all(":" in x for x in lines[1:]):
        raise Damaged("header line without a name")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if len(headers) < len(lines) - 1:
        raise Damaged("header field twice")  # a header that breaks off runs into the next one
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no length")
    begin = stop + len(END)
    finish = begin + int(headers["content-length"])
    if data[finish : finish + len(END)] != END or whole and finish + len(END) != len(data):
        raise Damaged("length doesn't fit")
    block = data[begin:finish]
    wanted = headers.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted[5:] != digest(block):
        raise Damaged("block digest differs")
    payload, n, own = None, None, headers.get("warc-payload-digest", "sha1:")[5:] or None
    if headers.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(END)
        m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        n = int(m[1]) if m else None
        if headers.get("warc-type") != "revisit":
            payload, n = body, len(body)
            if own is not None and own != digest(body):
                raise Damaged("payload digest differs")
            own = digest(body)
    return Found(at, finish + len(END) - at, None, headers, n, own, payload), finish + len(END)


def inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """What the gzip member at a position holds, and where it ends."""
    z, out, i = zlib.decompressobj(31), [], at
    while not z.eof:
        piece = data[i : i + 16384]
        if not len(piece):
            raise Damaged("member breaks off")
        try:
            out.append(z.decompress(piece))
        except zlib.error as e:
            raise Damaged(f"member: {e}") from None
        i += len(piece)
    return b"".join(out), i - len(z.unused_data)


def salvage(data: bytes) -> Iterator[Found]:
    """All right records of an archive file in order, and the gaps between them."""
    view, at, gap, reason = memoryview(data), 0, None, ""
    while at < len(data):
        try:
            if data.startswith(MAGIC, at):
                inside, end = inflate(view, at)
                found = parse(inside, whole=True)[0]._replace(at=at, length=end - at) if inside else None
            else:
                found, end = parse(data, at)
        except Damaged as e:
            gap, reason = (at, str(e)) if gap is None else (gap, reason)
            nexts = [x for x in (data.find(MAGIC, at + 1), data.find(VERSION, at + 1)) if x >= 0]
            at = min(nexts, default=len(data))
            continue
        if gap is not None:
            yield Found(gap, at - gap, reason, {}, None, None, None)
            gap = None
        if found is not None:
            yield found
        at = end
    if gap is not None:
        yield Found(gap, len(data) - gap, reason, {}, None, None, None)


def with_roles(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """Adds ``payload`` (bytes), ``sha1`` and ``refers_to``: the smallest id with an equal payload, if another's.

    Only digests that several rows have are joined back. That table is written first, so both sides of the join
    are plain exchanges and Spark may split a digest that many rows have.
    """
    made = ("payload", "sha1", "refers_to")
    own = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    rows = pages.select(*own, F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    first = rows.groupBy("sha1").agg(F.min(page_id).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("sha1").alias("_sha1"), F.col("first").alias("_first"))
    first = scratch.put(first, "first")
    met = rows.alias("r").join(first, F.expr("sha1 = _sha1"), "left")
    return met.select("r.*", F.expr(f"if(`{page_id}` <=> _first, null, _first)").alias("refers_to"))


def _runs(members: list[bytes]) -> pa.RecordBatch:
    """One value of some members, which an empty member ends in the file."""
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])


def write(rows: DataFrame, path: str, page_id: str = "page_id", url: str = "url") -> None:
    """Writes rows of with_roles() as archives under a path of any file system that Spark knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for p, u, b, s, r in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    held.append(member(record(p, u, b, r, base64.b32encode(s).decode())))
                    size += len(held[-1])
                    if size >= RUN:
                        yield _runs(held)
                        held, size = [], 0
        if held:
            yield _runs(held)

    made = rows.select(page_id, url, "payload", "sha1", "refers_to").mapInArrow(run, "value binary")
    (
        made.select(F.col("value").cast("string").alias("value"))
        .write.mode("overwrite")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", RUNS)
        .text(path)
    )


def read(spark: SparkSession, path: str, payloads: bool = False, names: str = "*") -> DataFrame:
    """Records and gaps of all archives under a path, of the names that a glob pattern gives: archive, at, length, reason (null for records), the named
    headers, payload_bytes, payload_digest, and the payload if asked for."""
    schema = "archive string, at bigint, length bigint, reason string, record_type string, record_id string, refers_to string, url string, payload_bytes bigint, payload_digest string" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for x in salvage(content.as_py()):
                    h = x.headers.get
                    rows.append((name, x.at, x.length, x.reason, h("warc-type"), h("warc-record-id"), h("warc-refers-to"), h("warc-target-uri"), x.payload_bytes, x.payload_digest, *[x.payload] * payloads))
                    if len(rows) == 1024:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * payloads]
    columns = [x.split()[0] for x in schema.split(", ")]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=columns)

    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("path", "content").mapInArrow(run, schema)


def page_number(column: str) -> Column:
    """The page id in a record id of this writer; null if it has none."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
