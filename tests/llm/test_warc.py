"""Archives and their index: round trips, look-ups against a scan, and odd pages."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from voxlake.llm import warc
from voxlake.llm.common import shared_folder

SCHEMA = "page_id bigint, url string, html string, key string, archive string, offset int, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "a", 1, "d") for i, u, h in rows], SCHEMA)


def brute(rows, least=100):
    """Rows of (page_id, length, digest, type, refers_to)."""
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        later = len(data) >= least and ids and i != min(ids)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", min(ids) if later else None))
    return Counter(out)


def got(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    html = ["<p>" + "é" * 60, "x" * 99, "x" * 100, "\r\n\r\n" * 40, "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5, "a\x00b\tc" * 40, "long " * 300_000, None, ""]
    hosts = ["Example.com", "www.example.com:80", "a.b.example.org.", "[::1]:8080", "", "bücher.example"]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.randrange(9)}", rng.choice(html)) for i in range(60)]
    return [*rows, (None, "http://n/", html[0]), (3, "http://other/", html[0]), (3, "http://other/", html[0]), (3, "tab\tin url\r\nX: y", "z" * 150), (70, None, "z" * 150), (None, None, "alone" * 50), (None, None, "alone" * 50)]


def test_pages(spark, pages):
    assert got(warc.archived_pages(frame(spark, pages).repartition(5))) == brute(pages)
    assert got(warc.archived_pages(frame(spark, pages), least=10**9)) == brute(pages, 10**9)
    assert warc.archived_pages(frame(spark, pages).where("false")).count() == 0
    third = [(i, "http://hot.example/", "hot page " * 20) for i in range(200)]
    assert got(warc.archived_pages(frame(spark, third + pages))) == brute(third + pages)


def test_groups_that_are_not_broadcast(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    assert got(warc.archived_pages(frame(spark, pages))) == brute(pages)


def test_archives_are_gzip_members_that_any_reader_can_read(spark, pages):
    captures = warc.write_archives(warc.captures_to_write(frame(spark, pages)), shared_folder(spark, "warc-test"))
    assert captures.count() == len(pages) and Counter(map(tuple, captures.collect())) == Counter(map(tuple, warc.read_archives(captures).collect()))
    for r in captures.groupBy("archive").agg(F.count("*").alias("records"), F.sum("length").alias("bytes")).collect():
        fs, path = pyarrow.fs.FileSystem.from_uri(r.archive)
        data = fs.open_input_file(path).read()
        assert len(data) == r.bytes and gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == r.records
        with warc._streamed(r.archive) as file:
            for offset, length, content in warc._members(file):
                assert gzip.decompress(data[offset : offset + length]) == content


def test_index_against_scan(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "PART_LINES", 12)
    rows = [*pages, *((100 + i, "http://example.com/7", f"{i}") for i in range(40))]
    folder = shared_folder(spark, "warc-test")
    records = warc.read_archives(warc.write_archives(warc.captures_to_write(frame(spark, rows)), folder))
    index = warc.write_index(records, folder)
    assert index.count() > 3 and index.where("blocks > 1").count() > 1
    assert [r.captures for r in index.groupBy().sum("captures").toDF("captures").collect()] == [len(rows)]
    columns = ("key", "record_id", "archive", "offset", "length", "type", "payload_digest")
    there = [tuple(r[c] for c in columns) for r in records.collect()]
    keys = sorted({r[0] for r in there}) + ["", "aaa", "zzz", "com,example)/7x"]
    wanted = spark.createDataFrame([(k, None) for k in keys] + [(None, None)], "key string, record_id string")
    assert Counter(map(tuple, warc.look_up(index, wanted).collect())) == Counter(there)
    one = spark.createDataFrame([(r[0], r[1]) for r in there[::5]] + [("com,example)/7", "<urn:page:none>")], "key string, record_id string")
    asked = {(r[0], r[1]) for r in there[::5]}
    found = warc.look_up(index, one)
    assert Counter(map(tuple, found.collect())) == Counter(r for r in there if r[:2] in asked)
    texts = {(i, hashlib.sha256((h or "").encode()).hexdigest()): (h or "").encode() for i, _, h in rows}
    for r in warc.payloads(found.where("type = 'response' and record_id <> '<urn:page:>'")).collect():
        assert texts[int(r.record_id[10:-1]), r.payload_digest] == r.payload


@pytest.mark.parametrize("url, key", [
    ("https://user@www.Example.com:443/a?b#c", "com,example,www)/a?b"), ("http://example.com", "com,example)/"), ("http://example.com:8080/x", "com,example:8080)/x"), ("//example.com/y", "com,example)/y"),
    ("http://[::1]:80/", "[::1])/"), ("", ")/"), ("http://a.b.c.?q=1", "c,b,a)/?q=1"), ("ftp://h:80/", "h:80)/"),
])
def test_reversed_host(url, key):
    assert warc.reversed_host(url) == key


def test_cut_archives_are_errors(spark, tmp_path):
    record = warc._packed(warc.record_bytes("response", "<urn:page:1>", "http://a/", "0", b"payload", None, None, "1970-01-01T00:00:00Z"))
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(record + record[:-9])
    with warc._streamed(f"file://{path}") as file, pytest.raises(ValueError, match="ends within"):
        list(warc._members(file))
    with pytest.raises(ValueError, match="before its length"):
        warc.parsed_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
