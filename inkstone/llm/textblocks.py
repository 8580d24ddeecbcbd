"""Whole texts as flat byte arrays: words, word hashes and k-word hashes, vectorised.

The operators of this package read texts in Arrow batches. A batch is cut into
blocks of bounded bytes (a longer text is a block of its own), and a block is one
``uint8`` array with row offsets. Words are ``[^\\x20\\x09-\\x0D]+`` runs of UTF-8
bytes. All hashes are 64-bit polynomials over random byte values, finished with an
avalanche mix, so equal words have equal hashes on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + 64)
        for k, base in enumerate((_STEP, _UNSTEP)):
            grown = np.full(m, base, U)
            grown[0] = 1
            _powers[k] = np.cumprod(grown, dtype=U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences are polynomial hashes; entry i covers values[:i]."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], dtype=U, out=out[1:])
    return out


class Block:
    """Some rows' texts: bytes, row offsets, and on demand their words."""

    def __init__(self, first_row: int, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        self.first_row, self.off, self.n = first_row, off, len(off) - 1
        self.buf = LOWER[buf] if lower else buf
        blank = _SPACE[self.buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        begin, end = ~blank, ~blank
        begin[1:] &= blank[:-1] | edge[1:-1]
        end[:-1] &= blank[1:] | edge[1:-1]
        self.ws, self.we = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.wo = np.searchsorted(self.ws, off)  # words of row r: wo[r]:wo[r+1]
        self.n_words = np.diff(self.wo)
        self._hash: np.ndarray | None = None

    @property
    def word_hash(self) -> np.ndarray:
        if self._hash is None:
            sums = rolling(_RANDOM[self.buf])
            inverse = powers(len(self.buf) + 1)[1]
            self._hash = mix((sums[self.we] - sums[self.ws]) * inverse[self.ws] + (self.we - self.ws).astype(U))
        return self._hash

    def word_row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one row."""
        return kgrams(self.word_hash, self.wo, k)

    def text(self, row: int) -> bytes:
        return self.buf[self.off[row] : self.off[row + 1]].tobytes()

    def word(self, i: int) -> bytes:
        return self.buf[self.ws[i] : self.we[i]].tobytes()


def kgrams(h: np.ndarray, wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hashes of hashed words h, rows bounded by wo; the flags tell which are whole."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    sums, inverse = rolling(h), powers(len(h) + 1)[1]
    out = mix((sums[k:] - sums[:-k]) * inverse[:m] + U(k))
    whole = np.ones(m, bool)
    row = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
    whole = row[:m] == row[k - 1 :]
    return out, whole


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def blocks(batch: pa.RecordBatch, name: str = "text", lower: bool = False, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The batch's texts in blocks of at most ``most`` bytes, or of one row."""
    if not batch.num_rows:
        return
    raw, off = flat(batch.column(name))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        stop = min(stop, batch.num_rows)
        yield Block(row, raw[off[row] : off[stop]], off[row : stop + 1] - off[row], lower)
        row = stop


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.int64()).to_numpy(zero_copy_only=False)


def packed(arrays: list[np.ndarray]) -> pa.Array:
    """A binary column with one array's bytes a row."""
    return pa.array([a.tobytes() for a in arrays], pa.binary())
