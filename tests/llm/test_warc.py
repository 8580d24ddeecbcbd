import hashlib
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import warc_archive as w

from .helpers import table

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nWARC-Payload-Digest: sha1:x\r\nX-Payload-Length: 3\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
SCHEMA = "page_id bigint, url string, html string"


def pages():
    big = "<p>ü" + "y" * 2000
    return [
        (1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://c", "small"), (5, "http://d", "small"),
        (6, "http://e\r\nWARC-Type: x", FAKE * 3), (7, "http://f", "before " + FAKE + "z" * 1500), (8, "", ""), (9, "http://g", None),
        (10, "http://h", "\r\n\r\n" * 400), (11, "http://i", "WARC/1.0\r\n" * 300), (12, "http://j", "x" * 300_000), (None, "http://k", "no id"),
        (13, "http://l", "e" * 999), (14, "http://m", "e" * 999), (15, "http://n", "f" * 1000), (16, "http://o", "f" * 1000), (17, "u", "line\nfeeds\r\n end"),
    ]


def expected(rows):
    last = defaultdict(int)
    for page, _, html in rows:
        if page is not None:
            last[html or ""] = max(last[html or ""], page)
    out = {}
    for page, _, html in rows:
        if page is None:
            continue
        data = (html or "").encode()
        again = len(data) >= 1000 and last[html or ""] != page
        out[page] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[html or ""] if again else None)
    return out


def run(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in w.archived(df).collect()}


def test_round_trip(spark):
    assert run(table(spark, pages(), schema=SCHEMA)) == expected(pages())


def test_many_revisits_take_the_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(w, "BROADCAST_ROWS", 0)
    assert run(table(spark, pages(), schema=SCHEMA)) == expected(pages())


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a", "q" * 1200), (1, "a", "q" * 1200), (2, "b", "r")]
    found = w.archived(table(spark, rows, schema=SCHEMA)).collect()
    assert sorted((r.page_id, r.record_type) for r in found) == [(1, "response"), (1, "response"), (2, "response")]
    assert run(table(spark, [], schema=SCHEMA)) == {}


@pytest.fixture
def splits(spark):
    """Sets the bytes of a file's block for a test."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


@pytest.mark.parametrize("size", [97, 700, 5000])
def test_files_are_split_among_tasks(spark, splits, size):
    """Cuts in headers, at line ends, and in payloads that hold whole fake records."""
    rows = pages() if size > 500 else [r for r in pages() if r[0] not in (10, 11, 12)]
    path = w.folder(spark, "test")
    w.write_archive(table(spark, rows, schema=SCHEMA).coalesce(2), path)
    splits(size)
    found = w.read_archive(spark, path).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == expected(rows)
    assert len(found) == len(expected(rows))
    assert w._lines(spark, path).select("path", "start").distinct().count() > 5
    for r in found:  # each offset is a record's first byte
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert f.read(len(w.MAGIC)) == w.MAGIC


def test_no_payload_is_shuffled(spark):
    rows = table(spark, pages(), schema=SCHEMA)
    path = w.folder(spark, "test")
    w.write_archive(rows, path)
    assert "value" not in w._entries(spark, w._lines(spark, path)).columns
    sized = rows.select("page_id", "url", "html").withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("bigint"))
    again = sized.where("page_id = 1").select("page_id", "digest", "size", F.lit(3).cast("bigint").alias("refers_to"))
    told = w._revisited(sized, again)
    assert {r.page_id for r in told.where("refers_to is not null").collect()} == {1} and told.count() == sized.count()


@pytest.mark.parametrize("most", [0, 2])
def test_the_bit_array_finds_every_revisit(spark, monkeypatch, most):
    monkeypatch.setattr(w, "BROADCAST_ROWS", most)
    monkeypatch.setattr(w, "PIECE_WORDS", 1)  # few bits, so many pages are mistaken
    monkeypatch.setattr(w, "SIEVE_PIECES", 2)
    rows = [(k, f"http://{k}", f"{k % 90} " * 500) for k in range(150)]
    assert run(table(spark, rows, schema=SCHEMA)) == expected(rows)


def written(spark, data: bytes):
    path = w.folder(spark, "test")
    local = path.removeprefix("file:")
    os.makedirs(local)
    with open(f"{local}/part-0", "wb") as f:
        f.write(data)
    return path


@pytest.mark.parametrize("size", [60, 10**6])
def test_chain_rejects_candidates_inside_payloads(spark, splits, size):
    payload = FAKE * 3 + "WARC/1.0\r\nWARC/1.0\r\nContent-Length: 5\r\n"
    sha = hashlib.sha1(payload.encode()).hexdigest()
    block = "HTTP/1.1 200 OK\r\n\r\n" + payload
    record = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{{}}>\r\nWARC-Payload-Digest: sha1:{sha}\r\nX-Payload-Length: {len(payload)}\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"
    path = written(spark, (record.format(5) + record.format(6)).encode())
    splits(size)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.offset) for r in w.read_archive(spark, path).collect()) == [(5, len(payload), sha, 0), (6, len(payload), sha, len(record) - 1)]


def test_pointer_jumping_follows_long_chains(spark):
    n = 1000
    at = np.arange(n) * 10
    to, last = w.jumped(at, at + 10)
    assert (to == n * 10).all() and (last == at[-1]).all()
    links = spark.createDataFrame([("f", int(x), int(x) + 10) for x in at[:60]] + [("f", 5, 17)], "path string, at bigint, exit bigint")
    assert {r["at"] for r in w._chain(links).collect()} == set(range(0, 601, 10))


@pytest.mark.parametrize("size", [40, 10**6])
@pytest.mark.parametrize("data", [FAKE + "garbage\r\n" + FAKE, "garbage\r\n" + FAKE, FAKE + "garbage\n", FAKE[:-20] + "\n"])
def test_a_broken_chain_is_an_error(spark, splits, size, data):
    path = written(spark, data.encode())
    splits(size)
    with pytest.raises(ValueError, match="the chain of records"):
        w.read_archive(spark, path)
