import base64
import gzip
import hashlib
import os

from flowloom.llm.common import Scratch
from flowloom.llm.warc import archived_pages, read_warc, write_warc


def expected(rows, min_bytes=0):
    low = lambda x: (x is not None, x or 0)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        head = max(same, key=low) if len(data) >= min_bytes else page
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if head == page else "revisit", None if head == page else head))
    return sorted(out, key=str)


def round_trip(spark, rows, tmp_path, min_bytes=0):
    pages = spark.createDataFrame([(*r, 7, "x") for r in rows], "page_id long, url string, html string, at int, path string")
    scratch = Scratch(spark)
    write_warc(pages, str(tmp_path / "w"), min_bytes, scratch=scratch)
    return sorted(map(tuple, archived_pages(read_warc(spark, str(tmp_path / "w"), scratch), scratch).collect()), key=str)


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, "same"), (4, "u\r\nWARC-Type: x", None), (5, "e", ""), (6, "f", fake * 3),
            (7, "g", "x" + fake + "WARC/1.0\r\n"), (8, "h", "é🙂\r\n\r\n"), (None, "i", "same"), (None, "j", "alone"), (9, "k", "\r\n\r\n"), (10, "l", "y" * 100_000), (11, "m", "twice"), (11, "m", "twice")]
    assert round_trip(spark, rows, tmp_path) == expected(rows)


def test_min_bytes_and_empty(spark, tmp_path):
    rows = [(1, "a", "short"), (2, "b", "short"), (3, "c", "long enough"), (4, "d", "long enough")]
    assert round_trip(spark, rows, tmp_path / "a", 6) == expected(rows, 6)
    assert round_trip(spark, [], tmp_path / "b") == []


def test_foreign_archive(spark, tmp_path):
    record = lambda n, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(body) + 4}\r\n\r\n\r\n\r\n{body}\r\n\r\n".encode()
    os.makedirs(tmp_path / "f")
    inner = record(50, "inner").decode()
    (tmp_path / "f/a.warc.gz").write_bytes(gzip.compress(record(1, "one")) + gzip.compress(record(2, inner)))
    (tmp_path / "f/b.warc").write_bytes(record(3, "three"))
    got = read_warc(spark, str(tmp_path / "f")).collect()
    assert sorted(r.record_id for r in got) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]


def test_pages(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert round_trip(spark, rows, tmp_path) == expected(rows)
