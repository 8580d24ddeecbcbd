"""Approximate nearest neighbours by cosine along shifted space-filling curves.

*Index.* Each of ``CURVES`` curves has its own orthonormal projection of the unit vectors
to ``DIMENSIONS`` coordinates, mapped to [0, 1/2) by the normal distribution that random
directions have, shifted by a random offset below 1/2 and cut to ``BITS`` bits; the cell's
place on the Hilbert curve is the key. Every row is indexed on every curve. Each curve is
cut into key ranges of equal numbers of rows, ``BLOCKS`` of them or as many as leave
``BLOCK_ROWS`` rows each. What is fitted is only where the cuts lie: at the quantiles of the
keys of about ``SAMPLE`` rows, chosen by a hash of their ids.

*Search.* A query looks at its own range and its two neighbours on every curve. Rows travel
along the curves as 8-bit codes and keys, packed by task, not as vectors; a range that holds
more than ``CELL_ROWS`` rows by the sample (one key may hold a third of all) is dealt into
cells of that size, and its queries into cells of ``CELL_QUERIES``, so what meets in a group
is bounded. Each cell keeps a query's ``kept`` best by code, and of all cells the ``FINAL``
best are reranked by the cosine of the original vectors in double precision; ties go to the
smaller vec_id. Tables of at most ``3 * BLOCK_ROWS`` rows are one range of one curve, and so
are searched whole.

Codes tell cosines apart that differ by more than about 0.002: among more than ``FINAL``
vectors that are closer to each other than that, which are reranked is chance.

*Work.* A query meets 3 * CURVES / BLOCKS of the rows, 45 % of them, however many there are:
less than an exact scan, but in proportion to the rows. The shuffle is rows times curves
(times the cells that their queries fill), whatever the number of queries per range.

Of equal vectors only the k + 1 smallest vec_ids are candidates: any other loses every tie
against k of them, so this drops no result and keeps a hot vector from filling ranges.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows without a vec_id. Vectors of different lengths have no cosine and are indexed apart.
Rows that repeat a vec_id count once, with the smallest vector. Fewer than k candidates give
as many ranks. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut
from .textblocks import U, mix

CURVES, DIMENSIONS, BITS, BLOCKS, BLOCK_ROWS, SAMPLE = 48, 15, 4, 320, 128, 20_000
CELL_ROWS, CELL_QUERIES, PARTITION_ROWS, FINAL = 32_768, 65_536, 1_000_000, 40
_POSTINGS = pa.schema([("to", pa.int32()), ("length", pa.int32()), ("asks", pa.bool_()), ("cells", pa.binary()), ("ids", pa.binary()), ("codes", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("near", pa.float32())])
_SUB, _ASK, _BLOCK = 22, 14, 12  # bits of a cell's number: rows dealt, queries dealt, range; the curve stands above


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer cells (rows, dimensions) on the Hilbert curve of that order (Skilling 2004)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > 1:
        p = q - one
        for i in range(n):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by powers of two first, so that no square over- or underflows."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


@lru_cache(maxsize=256)
def _curve(curve: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The curve's axes and shifts."""
    random = np.random.default_rng([curve, length])
    m = min(DIMENSIONS, length)
    axes, _ = np.linalg.qr(random.standard_normal((length, m)))
    return axes, random.random(m)


def curve_keys(units: np.ndarray, curve: int) -> np.ndarray:
    axes, shift = _curve(curve, units.shape[1])
    x = (units @ axes) * np.sqrt(units.shape[1])
    share = 1 / (1 + np.exp(-np.clip(1.5976 * x + 0.07056 * x**3, -500, 500)))  # the normal distribution, by its logistic approximation
    bits = min(15, BITS * DIMENSIONS // len(shift))
    place = (share + shift) / 2 * (1 << bits)
    return hilbert(np.clip(place.astype(np.int64), 0, (1 << bits) - 1), bits).astype(np.int64)


def coded(units: np.ndarray) -> np.ndarray:
    """Vectors in 8 bits a component, each scaled to its own largest."""
    return np.rint(units * (127 / np.abs(units).max(axis=1, keepdims=True))).astype(np.int8)


class Ranges:
    """What is broadcast: the cuts of each curve, and into how many cells a range's rows are dealt."""

    def __init__(self, keys: dict[int, np.ndarray], rows: int, queries: int, blocks: int, block_rows: int):
        """keys: by the vectors' length, the sample's keys (rows, curves)."""
        total = sum(len(x) for x in keys.values())
        self.asks = max(1, -(-3 * queries // (blocks * CELL_QUERIES)))
        self.cuts: dict[tuple[int, int], np.ndarray] = {}
        self.deal: dict[tuple[int, int], np.ndarray] = {}
        for length, own in keys.items():
            held = rows * len(own) / total
            n = int(min(blocks, max(1, held // block_rows)))
            if n <= 2:
                n = 1
            for curve in range(own.shape[1]):
                key = np.sort(own[:, curve])
                cuts = np.unique(key[(np.arange(1, n) * len(key)) // n])
                share = np.bincount(np.searchsorted(cuts, key, "right"), minlength=len(cuts) + 1) / len(key)
                self.cuts[length, curve] = cuts
                self.deal[length, curve] = np.maximum(1, np.ceil(share * held / CELL_ROWS)).astype(np.int64)

    def at(self, length: int, curve: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's range, and the numbers of cells of all ranges."""
        cuts = self.cuts.get((length, curve))
        if cuts is None:  # a length that the sample does not have: one range
            return np.zeros(len(key), np.int64), np.ones(1, np.int64)
        return np.searchsorted(cuts, key, "right"), self.deal[length, curve]


def _cell(curve: int, block: np.ndarray, ask: np.ndarray, sub: np.ndarray) -> np.ndarray:
    return (((curve << _BLOCK) + block << _ASK) + ask << _SUB) + sub


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts: its index so many times, and the numbers 0, 1, .. beside it."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(counts)][:-1], counts)


def row_cells(ranges: Ranges, length: int, curve: int, key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cell of each row, once for each cell that its range's queries fill."""
    block, deal = ranges.at(length, curve, key)
    sub = (mix(ids.astype(U)) % deal[block].astype(U)).astype(np.int64)
    of, ask = _spread(np.full(len(key), ranges.asks))
    return of, _cell(curve, block[of], ask, sub[of])


def query_cells(ranges: Ranges, length: int, curve: int, key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell): the cells of each query's range and its neighbours."""
    own, deal = ranges.at(length, curve, key)
    ask = (mix(ids.astype(U) + U(1)) % U(ranges.asks)).astype(np.int64)
    found = []
    for block in (own - 1, own, own + 1):
        some = np.flatnonzero((block >= 0) & (block < len(deal)))
        of, sub = _spread(deal[block[some]])
        found.append((some[of], _cell(curve, block[some[of]], ask[some[of]], sub)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _by_length(batch: pa.RecordBatch, name: str = "embedding") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batch's rows of each length, and their vectors."""
    column = batch.column(name)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), int(length))


def _keys(curves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, vectors in _by_length(batch):
                units = unit(vectors)
                keys = np.stack([curve_keys(units, c) for c in range(curves)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([vectors.shape[1]], pa.int32()), pa.array([keys.tobytes()], pa.binary())], ["length", "keys"])

    return run


def _postings(shared, curves: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        for batch in batches:
            ids, flags = batch.column("vec_id").to_numpy(), {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("candidate", "asks")}
            for rows, vectors in _by_length(batch):
                units, length = unit(vectors), vectors.shape[1]
                codes = coded(units)
                for curve in range(curves):
                    key = curve_keys(units, curve)
                    for asks, cells in ((False, row_cells), (True, query_cells)):
                        some = np.flatnonzero(flags["asks" if asks else "candidate"][rows])
                        if not len(some):
                            continue
                        of, cell = cells(ranges, length, curve, key[some], ids[rows[some]])
                        to = (mix(cell.astype(U)) % U(n)).astype(np.int32)
                        order = np.argsort(to, kind="stable")
                        of, cell = some[of[order]], cell[order]
                        edge = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0, True])
                        parts = list(zip(edge[:-1], edge[1:], strict=True))
                        columns = [[x[a:b].tobytes() for a, b in parts] for x in (cell, ids[rows[of]], codes[of])]
                        yield pa.RecordBatch.from_arrays([pa.array(to[order][edge[:-1]]), pa.array(np.full(len(parts), length), pa.int32()), pa.array(np.full(len(parts), asks)), *(pa.array(c, pa.binary()) for c in columns)], schema=_POSTINGS)

    return run


def best(queries: np.ndarray, query_ids: np.ndarray, codes: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, near) of each query's k best of the codes, itself left out."""
    rows = codes.astype(np.float32)
    rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    out = []
    for at in range(0, len(queries), 256):
        asked, own = queries[at : at + 256].astype(np.float32), query_ids[at : at + 256]
        near = (asked / np.sqrt((asked * asked).sum(axis=1, keepdims=True))) @ rows.T
        near[own[:, None] == ids[None, :]] = -np.inf
        if near.shape[1] > k:
            place = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        else:
            place = np.tile(np.arange(near.shape[1]), (len(own), 1))
        score = np.take_along_axis(near, place, axis=1)
        some = score > -np.inf
        out.append((np.repeat(own, place.shape[1]).reshape(place.shape)[some], ids[place[some]], score[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _met(kept: int):
    """The queries of each cell of a partition against its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[list[bytes]]] = defaultdict(lambda: [[], [], []])
        for batch in batches:
            for length, asks, *packed in zip(*(batch.column(c).to_pylist() for c in ("length", "asks", "cells", "ids", "codes")), strict=True):
                for out, x in zip(held[length, asks], packed, strict=True):
                    out.append(x)
        found = []
        for length in sorted({x for x, _ in held}):
            if (length, True) not in held or (length, False) not in held:
                continue
            sides = []
            for asks in (True, False):
                cell, ids, codes = (b"".join(x) for x in held.pop((length, asks)))
                cell, ids, codes = np.frombuffer(cell, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(codes, np.int8).reshape(-1, length)
                order = np.lexsort((ids, cell))
                sides.append((cell[order], ids[order], codes[order]))
            (ask_cell, ask_ids, ask_codes), (cell, ids, codes) = sides
            for c in np.unique(ask_cell):
                a, b = np.searchsorted(cell, c, "left"), np.searchsorted(cell, c, "right")
                x, y = np.searchsorted(ask_cell, c, "left"), np.searchsorted(ask_cell, c, "right")
                if b > a:
                    found.append(best(ask_codes[x:y], ask_ids[x:y], codes[a:b], ids[a:b], kept))
        if found:
            query, vec, near = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((vec, query))
            query, vec, near = query[order], vec[order], near[order]
            new = np.ones(len(query), bool)
            new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(query[new]), pa.array(vec[new]), pa.array(near[new], pa.float32())], schema=_FOUND)

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of the original vectors, in double precision."""
    for batch in batches:
        for (rows, asked), (_, vectors) in zip(_by_length(batch, "asked"), _by_length(batch), strict=True):
            asked, vectors = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (asked, vectors))
            score = (asked * vectors).sum(axis=1) / (np.sqrt((asked * asked).sum(axis=1)) * np.sqrt((vectors * vectors).sum(axis=1)))
            of = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(of), batch.column("vec_id").take(of), pa.array(score)], ["query_id", "vec_id", "score"])


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) that take part, as doubles."""
    own = embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return own.where(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def search(embeddings: DataFrame, is_query, k: int = 5, curves: int = CURVES, blocks: int = BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that is_query (a Column of vec_id) holds for."""
    spark = embeddings.sparkSession
    same = Window.partitionBy("embedding").orderBy("vec_id")
    asks = F.coalesce(is_query, F.lit(False))
    rows = usable(embeddings)
    first = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", F.lit(True).alias("candidate"))
    rows = cut(rows.join(first, "vec_id", "left").select("vec_id", "embedding", F.coalesce("candidate", F.lit(False)).alias("candidate"), asks.alias("asks")).where("candidate or asks"))
    count, queries = rows.agg(F.count("*"), F.count_if("asks")).first()

    if count <= 3 * block_rows:  # a query's three ranges would be all rows on every curve
        curves = blocks = 1
    one_in = max(1, count // SAMPLE)
    sampled = rows.where(F.col("candidate") & (F.pmod(F.xxhash64("vec_id"), F.lit(one_in)) == 0)).mapInArrow(_keys(curves), "length int, keys binary")
    keys: dict[int, list[np.ndarray]] = defaultdict(list)
    for length, own in sampled.collect():  # about SAMPLE rows' keys
        keys[length].append(np.frombuffer(own, np.int64).reshape(-1, curves))
    ranges = spark.sparkContext.broadcast(Ranges({x: np.concatenate(own) for x, own in keys.items()}, count, queries, blocks, block_rows))

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * curves // PARTITION_ROWS))
    posted = rows.mapInArrow(_postings(ranges, curves, n), "to int, length int, asks boolean, cells binary, ids binary, codes binary")
    found = posted.repartitionById(n, "to").mapInArrow(_met(k + 7), "query_id bigint, vec_id bigint, near float")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    finals = found.groupBy("query_id", "vec_id").agg(F.max("near").alias("near")).withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= max(FINAL, 4 * k)).select("query_id", "vec_id")
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    scored = finals.join(asked, "query_id").join(rows.select("vec_id", "embedding"), "vec_id").mapInArrow(_scored, "query_id bigint, vec_id bigint, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
