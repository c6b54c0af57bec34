import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from heddle.llm import queries, warc
from heddle.llm.scratch import Scratch


def archive(n, compressed=True):
    records = [warc.record(i, f"http://h/{i}", b"x" * i, None) for i in range(n)]
    return [warc.member(r) if compressed else r for r in records]


@pytest.mark.parametrize("compressed", [True, False])
def test_whole_archive(compressed):
    found = list(warc.salvage(b"".join(archive(5, compressed))))
    assert [f.payload for f in found] == [b"x" * i for i in range(5)] and all(f.reason is None for f in found)


def test_members_with_empty_ones_are_gzip():
    parts = archive(3)
    data = warc.EMPTY_MEMBER.join(parts) + warc.EMPTY_MEMBER
    assert gzip.decompress(data) == b"".join(map(gzip.decompress, parts))
    assert len(list(warc.salvage(data))) == 3


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "head"])
def test_salvage(compressed, damage):
    parts = archive(5, compressed)
    bad = bytearray(parts[2])
    if damage == "flip":
        bad[len(bad) // 2] ^= 0xFF
    elif damage == "cut":
        bad = bad[: len(bad) // 2]
    elif damage == "junk":
        bad = bytearray(b"\x1f\x8b\x08junk WARC/1.junk") + bad[10:]
    else:
        bad = bad[3:]
    parts[2] = bytes(bad)
    found = list(warc.salvage(b"".join(parts)))
    good = [f for f in found if f.reason is None]
    assert [f.headers["warc-record-id"] for f in good] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]
    gaps = [f for f in found if f.reason]
    assert sum(f.length for f in found) == sum(map(len, parts)) and gaps
    assert gaps[0].at == len(parts[0]) + len(parts[1])


def test_payload_that_looks_like_records():
    inner = warc.record(9, "u", b"inner", None)
    data = warc.record(1, "u", inner + warc.member(inner), None)
    assert [f.payload for f in warc.salvage(data + data)] == [inner + warc.member(inner)] * 2


def test_nothing():
    assert list(warc.salvage(b"")) == []
    (gap,) = warc.salvage(b"no archive")
    assert (gap.at, gap.length) == (0, 10)


def test_round_trip_with_edges(spark):
    rows = [(5, "http://a/1 x\n", "same", 1), (3, "http://a/2", "same", 1), (None, None, "same", 1), (7, "u", None, 1), (6, "u", "", 1), (8, "u", "é\r\n\r\nWARC/1.1\r\n", 1), (3, "http://a/2", "same", 1), (9, "u", "z" * 300_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int").withColumns({"payload": F.lit(1), "first": F.lit(2), "refers_to": F.lit(3), "n": F.lit(4)})
    s = Scratch(spark, "t")
    warc.write(warc.with_roles(df, s), s.at("a"))
    got = sorted((str(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, s.at("a")).collect())

    def one(i, text, refers):
        d = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        return (f"<urn:page:{'unknown' if i is None else i}>", len(text.encode()), d, "revisit" if refers else "response", f"<urn:page:{refers}>" if refers else None)

    want = [one(5, "same", 3), one(3, "same", None), one(None, "same", 3), one(7, "", 6), one(6, "", None), one(8, rows[5][2], None), one(3, "same", None), one(9, rows[7][2], None)]
    assert got == sorted(want)
    with_payload = warc.read(spark, s.at("a"), payloads=True).where("record_type = 'response' and record_id = '<urn:page:8>'").first()
    assert bytes(with_payload["payload"]) == rows[5][2].encode()
    warc.write(warc.with_roles(df.limit(0), s), s.at("none"))
    assert warc.read(spark, s.at("none")).count() == 0


def test_archives_are_cut_by_bytes(spark, monkeypatch):
    """Files end after so many runs, and the records of all are read."""
    monkeypatch.setattr(warc, "RUNS", 1)
    rows = [(i, "u", random.Random(i).randbytes(700_000).hex()) for i in range(5)] + [(9, "u", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    s = Scratch(spark, "t")
    warc.write(warc.with_roles(df, s).repartition(1), s.at("a"))
    found = warc.read(spark, s.at("a")).where("reason is null").collect()
    assert sorted(r["record_id"] for r in found) == [f"<urn:page:{i}>" for i in (0, 1, 2, 3, 4, 9)]
    assert len({r["archive"] for r in found}) >= 3


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/pages.parquet").collect()
    first = {}
    for r in rows:
        first[r["html"] or ""] = min(first.get(r["html"] or "", r["page_id"]), r["page_id"])
    want = set()
    for r in rows:
        data = (r["html"] or "").encode()
        f = first[r["html"] or ""]
        want.add((r["page_id"], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if f == r["page_id"] else "revisit", None if f == r["page_id"] else f))
    assert {tuple(r) for r in queries.op2_warc(spark, d).collect()} == want
