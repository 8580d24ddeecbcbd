"""WARC archives, written by Spark's text writer and read back by boundary-chain verification.

*Writing.* A record is a text: header, blank line, block. The writer ends each with the
WARC record end (CR LF CR LF) as its line separator, so files are committed, and recomputed
for lost executors, like any other table, on any file system Spark knows. Of records with
equal payloads of ``REVISIT_FROM`` bytes at least, the one with the largest page_id is
the response and the others are revisits, which carry the payload's digest and length but
no payload. Who revisits whom is found on keys. Up to ``BROADCAST_ROWS`` revisits are sent to
the pages; for more, a bit array of fixed size tells most pages that they are none, the
others are joined without their html, and only pages that the bits mistook are looked up
again, so payloads are not shuffled (unless those alone are more than ``BROADCAST_ROWS``).

*Reading.* Files are read by Spark's text source, line by line, in blocks that several tasks
share out whatever a file's size; a block's lines are its bytes, so the bytes of the blocks
before it give its place in the file. Every line ``WARC/1.0`` is a candidate record, whose
header, lines ``Name: value`` up to a blank one, gives the offset at which its successor must
begin. Payloads may hold the magic, even whole records, so candidates prove nothing.

1. A task emits its block's candidates with their successors; a chain inside the block is
   shortened by pointer jumping to the offset at which it leaves the block. A header that the
   block's end cuts is joined with the lines at the head of the blocks after it.
2. Candidates of all blocks meet by offset, and pointer jumping from the file's first byte,
   doubling each round, keeps the ones on the one chain from start to end of the file. A file
   whose chain breaks raises an error.
3. Each block is told the offset of its first record and of the record that reaches into it
   (a row for each block is broadcast), reads its records from there, and checks the payloads'
   digests. Records that lie in several blocks are put together from their pieces; a block has
   at most one at either end.

Null html is an empty payload, a null url the address ``urn:page:<page_id>``; blanks and
control characters of an url are percent-encoded. Rows without a page_id are not written.
Rows that repeat a page_id give a record each; of equal payloads those with the largest
page_id are all responses. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, folder

REVISIT_FROM, BROADCAST_ROWS, SIEVE_PIECES, PIECE_WORDS = 1000, 100_000, 128, 1 << 14
MAGIC, END = b"WARC/1.0\r\n", b"\r\n\r\n"
_FIELD = re.compile(rb"[A-Za-z0-9-]+: [^\n]*\r\n")
_RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])
_RESULT_DDL = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_KEY = ["page_id", "digest", "size"]


# ---- writing --------------------------------------------------------------------------
def _bit() -> tuple:
    """Piece, word and bit of a page's key in the bit array."""
    place = F.xxhash64(*_KEY)
    return F.pmod(place, F.lit(SIEVE_PIECES)).cast("int"), F.pmod(F.shiftright(place, 16), F.lit(PIECE_WORDS)).cast("int"), F.pmod(F.shiftright(place, 40), F.lit(64)).cast("int")


def _sieve(keys: DataFrame) -> DataFrame:
    """(piece, words): a bit for each hash value that some key has; ``SIEVE_PIECES`` rows of ``PIECE_WORDS`` words."""
    piece, word, bit = _bit()
    words = keys.select(piece.alias("piece"), word.alias("word"), bit.alias("bit")).groupBy("piece", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    held = words.groupBy("piece").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    return held.select("piece", F.expr(f"transform(sequence(0, {PIECE_WORDS - 1}), k -> coalesce(try_element_at(held, k), 0L))").alias("words"))


def _revisited(sized: DataFrame, again: DataFrame) -> DataFrame:
    """The pages with ``refers_to`` where they are revisits (whose html is null then, as it is not written)."""
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return sized.join(F.broadcast(again), _KEY, "left")
    piece, word, bit = _bit()
    sieve = F.broadcast(cut(_sieve(again)))
    told = sized.withColumn("piece", piece).join(sieve, "piece", "left").withColumn("maybe", F.coalesce(F.getbit(F.get("words", word), bit) == 1, F.lit(False))).drop("piece", "words")
    maybe = told.where("maybe").drop("maybe")
    revisits = maybe.drop("html").join(again, _KEY)
    mistaken = cut(maybe.select(*_KEY).join(again, _KEY, "left_anti").distinct())
    if mistaken.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        mistaken = F.broadcast(mistaken)
    first = told.where("not maybe").drop("maybe").unionByName(maybe.join(mistaken, _KEY, "left_semi"))
    return first.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(revisits, allowMissingColumns=True)


def write_archive(pages: DataFrame, path: str) -> None:
    """WARC files of all pages under path."""
    own = pages.where("page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sized = own.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("bigint"))
    large = cut(sized.where(F.col("size") >= REVISIT_FROM).select(*_KEY))
    last = large.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = cut(large.join(last, ["digest", "size"]).where("page_id < refers_to").select(*_KEY, "refers_to").distinct())
    records = _revisited(sized, again)
    url = F.coalesce(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x20]", "%20"), F.concat(F.lit("urn:page:"), F.col("page_id")))
    revisit = F.col("refers_to").isNotNull()
    http = F.when(revisit, F.lit(_HTTP + "\r\n")).otherwise(F.concat(F.lit(_HTTP + "Content-Length: "), F.col("size"), F.lit("\r\n\r\n")))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("page_id"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("size"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">")), F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"),
    )
    records.select(F.concat(header, block).alias("value")).write.option("lineSep", END.decode()).text(path)


# ---- reading --------------------------------------------------------------------------
class Block(NamedTuple):
    path: str
    start: int
    key: int


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.Array]]:
    """Batches of lines told apart by the blocks that they are of, which come one after the other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start, key = batch.column("path"), batch.column("start"), batch.column("block").to_numpy()
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield Block(path[a].as_py(), start[a].as_py(), int(key[a])), batch.column("value").slice(a, b - a)


def header_end(data: bytes, at: int) -> tuple[int, bool]:
    """Where the header of the candidate at ``at`` ends, behind its blank line, or -1; and whether it may go on past the data."""
    place = at + len(MAGIC)
    while place < len(data):
        if data.startswith(b"\r\n", place):
            return place + 2, False
        found = _FIELD.match(data, place)
        if found is None:
            return -1, False
        place = found.end()
    return -1, True


def fields(header: bytes) -> dict[bytes, bytes]:
    return dict(x.split(b": ", 1) for x in header[len(MAGIC) :].split(b"\r\n") if x)


def block_length(header: bytes) -> int | None:
    """The length that a header gives, or None."""
    length = fields(header).get(b"Content-Length", b"")
    return int(length) if re.fullmatch(rb"[0-9]{1,15}", length) else None


def jumped(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chain from each candidate leaves the candidates, and the last candidate on it, by pointer jumping."""
    n = len(at)
    if not n:
        return to, at
    place = np.searchsorted(at, to)
    inside = (place < n) & (at[np.minimum(place, n - 1)] == to)
    jump = np.where(inside, place, np.arange(n))  # the last one points to itself
    while True:
        far = jump[jump]
        if (far == jump).all():
            return to[jump], at[jump]
        jump = far


class _Found:
    """The candidates of one block."""

    def __init__(self, block: Block):
        self.block, self.size, self.lead, self.leads = block, 0, b"", True
        self.at: list[int] = []
        self.to: list[int] = []
        self.open: tuple[int, bytes] | None = None  # a header that has not ended: its offset and bytes

    def add(self, lines: pa.Array) -> None:
        length = pc.binary_length(lines).to_numpy() + 1
        place = self.size + np.r_[0, np.cumsum(length)]
        k = 0
        while self.leads and k < len(lines):  # header lines at the head of the block, for a candidate of the block before
            line = lines[k].as_py() + b"\n"
            self.leads = _FIELD.fullmatch(line) is not None
            if self.leads or line == b"\r\n":
                self.lead += line
            k += 1
        marks = np.flatnonzero(pc.equal(lines, MAGIC[:-1]).to_numpy(zero_copy_only=False))
        self._more(lines, 0, place)
        for k in marks:
            if self.open is not None:  # a header holds no magic line
                self.at.append(self.open[0])
                self.to.append(-1)
            self.open = (int(place[k]), MAGIC)
            self._more(lines, int(k) + 1, place)
        self.size = int(place[-1])

    def _more(self, lines: pa.Array, k: int, place: np.ndarray) -> None:
        """Reads on in the open header from line k on."""
        while self.open is not None and k < len(lines):
            line = lines[k].as_py() + b"\n"
            if line == MAGIC:
                return
            k += 1
            if _FIELD.fullmatch(line):
                self.open = (self.open[0], self.open[1] + line)
                continue
            at, header = self.open
            length = block_length(header) if line == b"\r\n" else None
            self.at.append(at)
            self.to.append(-1 if length is None else int(place[k]) + length + len(END))
            self.open = None

    def rows(self) -> pa.RecordBatch:
        at, to = np.array(self.at, np.int64), np.array(self.to, np.int64)
        exit_, last = jumped(at, to)
        columns = [[self.block.path] * (len(at) + 1), [self.block.start] * (len(at) + 1), [*at.tolist(), None], [*exit_.tolist(), None], [*last.tolist(), None], [None] * len(at) + [self.size], [None] * len(at) + [self.lead], [None] * len(at) + [None if self.open is None else self.open[0]], [None] * len(at) + [None if self.open is None else self.open[1]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CANDIDATES, strict=True)], schema=_CANDIDATES)


_CANDIDATES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("exit", pa.int64()), ("last", pa.int64()), ("size", pa.int64()), ("lead", pa.binary()), ("open_at", pa.int64()), ("open", pa.binary())])
_CANDIDATES_DDL = "path string, start bigint, at bigint, exit bigint, last bigint, size bigint, lead binary, open_at bigint, open binary"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of candidates (offsets count from the block's first byte) and, without ``at``, one of each block itself."""
    own: _Found | None = None
    for block, lines in _blocks(batches):
        if own is None or own.block != block:
            if own is not None:
                yield own.rows()
            own = _Found(block)
        own.add(lines)
    if own is not None:
        yield own.rows()


def _completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The successors of candidates whose header the end of their block cuts."""
    for batch in batches:
        rows = [(path, at, open_ + b"".join(x["lead"] for x in sorted(leads, key=lambda x: x["base"]))) for path, at, open_, leads in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "open", "leads")), strict=True)]
        ends = [header_end(data, 0)[0] for _, _, data in rows]
        lengths = [block_length(data[: end - 2]) if end > 0 else None for (_, _, data), end in zip(rows, ends, strict=True)]
        to = [-1 if n is None else at + end + n + len(END) for (_, at, _), end, n in zip(rows, ends, lengths, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("at"), pa.array(to, pa.int64())], ["path", "at", "exit"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", "part-*").text(path)
    place = text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    return place.withColumn("block", F.xxhash64("path", "start"))


def _chain(links: DataFrame) -> DataFrame:
    """(path, at): the links (path, at, exit) that are reached from offset 0, by pointer jumping."""
    on = links.where("at = 0").select("path", "at")
    jump = cut(links.select("path", "at", "exit"))
    while True:
        reached = on.join(jump, ["path", "at"]).select("path", F.col("exit").alias("at"))
        more = cut(on.unionByName(reached).distinct())
        far = jump.select("path", F.col("at").alias("exit"), F.col("exit").alias("far"))
        jump = cut(jump.join(far, ["path", "exit"], "left").select("path", "at", F.coalesce("far", "exit").alias("exit")))
        if more.join(on, ["path", "at"], "left_anti").isEmpty():
            return more
        on = more


def _entries(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """A row for each block: path, start, base (its first byte's offset), entry (its first record's offset, or null) and owner (the offset of the record that reaches into it, or null)."""
    found = cut(lines.mapInArrow(_candidates, _CANDIDATES_DDL))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut(found.where("size is not null").select("path", "start", "size", "lead", "open_at", "open", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")))
    base = whole.select("path", "start", "base")
    inner = found.where("size is null").join(base, ["path", "start"]).select("path", (F.col("at") + F.col("base")).alias("at"), F.when(F.col("exit") < 0, -1).otherwise(F.col("exit") + F.col("base")).alias("exit"), (F.col("last") + F.col("base")).alias("last"))
    cuts = whole.where("open is not null").select("path", "start", (F.col("open_at") + F.col("base")).alias("at"), "open")
    after = whole.where(F.length("lead") > 0).select("path", F.col("start").alias("other"), F.struct("base", "lead").alias("lead"))
    leads = cuts.join(after, "path", "left").where("other is null or other > start").groupBy("path", "start", "at", "open").agg(F.collect_list("lead").alias("leads"))
    opened = cuts.join(leads.select("path", "start", "leads"), ["path", "start"], "left").withColumn("leads", F.coalesce("leads", F.array().cast("array<struct<base:bigint,lead:binary>>")))
    closed = opened.select("path", "at", "open", "leads").mapInArrow(_completed, "path string, at bigint, exit bigint")
    links = inner.unionByName(closed.withColumn("last", F.col("at")))
    # of a block's candidates, only those that a chain enters from elsewhere can stand for it
    aims = links.select("path", F.col("exit").alias("at")).distinct()
    nodes = cut(links.join(aims, ["path", "at"], "left_semi").unionByName(links.where("at = 0")).distinct())
    on = _chain(nodes)
    held = nodes.join(on, ["path", "at"])
    ends = whole.groupBy("path").agg(F.sum("size").alias("end"))
    broken = ends.join(on.withColumnRenamed("at", "end"), ["path", "end"], "left_anti").where("end > 0").join(held.groupBy("path").agg(F.max("last").alias("last")), "path", "left")
    if (bad := broken.first()) is not None:
        raise ValueError(f"the chain of records of {bad['path']} " + ("does not begin" if bad["last"] is None else f"breaks at offset {bad['last']}"))
    spans = whole.select("path", "start", "base", "size").alias("w")
    inside = spans.join(held.alias("h"), "path").where("h.at >= w.base and h.at < w.base + w.size").groupBy("path", "start").agg(F.min("h.at").alias("entry"), F.max_by("h.last", "h.at").alias("last"))
    every = whole.select("path", "start", "base").join(inside, ["path", "start"], "left")
    return every.select("path", "start", "base", "entry", F.last("last", ignorenulls=True).over(before).alias("owner"))


def _record(record: bytes, path: str, at: int) -> tuple:
    """The row of a whole record, its payload checked."""
    end, _ = header_end(record, 0)
    field = fields(record[: end - 2])
    page, digest, size = int(field[b"WARC-Record-ID"][10:-1]), field[b"WARC-Payload-Digest"][5:].decode(), int(field[b"X-Payload-Length"])
    if field[b"WARC-Type"] == b"response":
        payload = record[record.find(END, end) + len(END) : len(record) - len(END)]
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"page {page}: the payload does not have its digest")
    to_page = field.get(b"WARC-Refers-To")
    return page, size, digest, field[b"WARC-Type"].decode(), int(to_page[10:-1]) if to_page else None, path, at


_PIECES = pa.schema([*_RESULT, ("owner", pa.int64()), ("place", pa.int64()), ("piece", pa.binary())])


class _Entries:
    """What is broadcast of each block, by a hash of its path and start: 32 bytes."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows.column("block").to_numpy())
        self.block, *self.columns = (rows.column(c).fill_null(-1).to_numpy()[order] for c in ("block", "base", "entry", "owner"))

    def of(self, block: int) -> tuple[int, int | None, int | None]:
        """The block's base, entry and owner."""
        at = int(np.searchsorted(self.block, block))
        if at == len(self.block) or self.block[at] != block:
            raise ValueError("a block that was not there when the archive was indexed")
        base, entry, owner = (int(c[at]) for c in self.columns)
        return base, None if entry < 0 else entry, None if owner < 0 else owner


class _Reader:
    """Reads one block's records, as its bytes come: whole ones, and pieces of those that lie in other blocks as well."""

    def __init__(self, path: str, base: int, entry: int | None, owner: int | None):
        self.path, self.at, self.entry, self.owner = path, base, entry, owner
        self.data, self.need = bytearray(), 0  # bytes from offset ``at`` on, and how many the record there has
        if owner is not None and entry is not None:
            self.need = entry - base

    def _piece(self, owner: int, size: int) -> tuple:
        return (*[None] * 5, self.path, None, owner, self.at, bytes(self.data[:size]))

    def add(self, data: bytes) -> Iterator[tuple]:
        self.data += data
        if self.entry is None or len(self.data) < self.need:
            return
        if self.owner is not None:  # the end of a record that began in a block before
            if self.need:
                yield self._piece(self.owner, self.need)
            self._drop(self.need)
            self.owner = None
        raw, done, self.need = bytes(self.data), 0, 0
        while done < len(raw):
            end, _ = header_end(raw, done)
            if end < 0:
                break
            size = end - done + block_length(raw[done : end - 2]) + len(END)
            if done + size > len(raw):
                self.need = size
                break
            yield (*_record(raw[done : done + size], self.path, self.at + done), None, None, None)
            done += size
        self._drop(done)

    def _drop(self, size: int) -> None:
        del self.data[:size]
        self.at += size

    def close(self) -> Iterator[tuple]:
        if self.data:
            yield self._piece(self.at if self.owner is None else self.owner, len(self.data))


def _records(shared):
    """Rows of the records that lie in one block, and the pieces of the others."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, rows = None, None, []
        for block, lines in _blocks(batches):
            if block != now:
                if reader is not None:
                    rows += reader.close()
                now, reader = block, _Reader(block.path, *shared.value.of(block.key))
            rows += reader.add(b"\n".join(lines.to_pylist()) + b"\n")
            if len(rows) >= 1000:
                yield batch(rows)
                rows = []
        if reader is not None:
            rows += reader.close()
        if rows:
            yield batch(rows)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, owner, pieces in zip(*(batch.column(c).to_pylist() for c in ("file", "owner", "pieces")), strict=True):
            rows.append(_record(b"".join(x["piece"] for x in sorted(pieces, key=lambda x: x["place"])), path, owner))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_RESULT), _RESULT, strict=True)], schema=_RESULT)


@contextmanager
def _fixed_splits(spark: SparkSession) -> Iterator[None]:
    """Files are split alike in all jobs within, also if executors come or go in between."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under path: page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset."""
    lines = _lines(spark, path)
    with _fixed_splits(spark):
        entries = _Entries(_entries(spark, lines).select(F.xxhash64("path", "start").alias("block"), "base", "entry", "owner").toArrow())  # a row for each block
        read = cut(lines.mapInArrow(_records(spark.sparkContext.broadcast(entries)), _RESULT_DDL + ", owner bigint, place bigint, piece binary"))
    cuts = read.where("piece is not null").groupBy("file", "owner").agg(F.collect_list(F.struct("place", "piece")).alias("pieces"))
    return read.where("piece is null").select(*_RESULT.names).unionByName(cuts.mapInArrow(_joined, _RESULT_DDL))


def archived(pages: DataFrame) -> DataFrame:
    """The pages written as archives to the shared checkpoint folder, and read back; the archives go when the driver ends."""
    path = folder(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
