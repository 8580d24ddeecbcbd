"""Quality classifier: similarity-weighted votes of labelled latent-semantic vectors.

A text's terms are what quality shows in: pairs of neighbouring character classes
(letters by case, digits, blanks, each kind of mark), counted over the whole text; how
much of it repeats: neighbouring equal words, word triples seen before, and words seen
before; and its words (letters and digits, in lower case), hashed to ``WORDS`` terms. The
order of words is no term. Square-rooted term shares, weighted by inverse document frequency and
projected on the leading singular vectors of the labelled sample, are its latent vector.

At most ``PER_CLASS`` labelled documents of each class teach (a documented bound); their
latent vectors are broadcast, at most 2 * PER_CLASS * RANK floats. For every document the
cosines with *all* of them are computed exactly, in blocks, and each labelled neighbour
votes for its label with weight exp(SHARPNESS * (cosine - 1)), classes weighted back to
their shares among all labels. The score is the share of the votes for label 1.

Null and empty texts, and texts without any term, score the share of label 1 among the
labels. Without labels every score is 0.5. Each row is scored by itself: rows that repeat
a doc_id give a row each, and a row without doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import remainder, share_of_ones, training_sample
from .textblocks import LOWER, Block, U, blocks, mix, powers, rolling

PER_CLASS, RANK, SHARPNESS, THRESHOLD = 3000, 32, 40.0, 0.3
_CLASSES = 19
_CLASS = np.full(256, 18, np.uint8)  # other marks
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 4, 5
for _k, _mark in enumerate(b".,!?|%&$*#-:"):
    _CLASS[_mark] = 6 + _k
PAIRS = _CLASSES * _CLASSES
WORDS = 1024
TERMS = PAIRS + 3 + WORDS
_REPEAT_WEIGHT, _WORD_WEIGHT = 0.7, 0.3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def terms(block: Block) -> np.ndarray:
    """Square-rooted term shares, a row for each text."""
    out = np.zeros((block.n, TERMS), np.float32)
    if not len(block.buf):
        return out
    kind = _CLASS[block.buf].astype(np.int64)
    pair = kind[:-1] * _CLASSES + kind[1:]
    for r in range(block.n):
        a, b = int(block.off[r]), int(block.off[r + 1])
        if b - a < 2:
            continue
        counts = np.bincount(pair[a : b - 1], minlength=PAIRS)
        out[r, :PAIRS] = np.sqrt(counts / (b - a - 1))
        wa, wb = int(block.wo[r]), int(block.wo[r + 1])
        if (n := wb - wa) < 4:
            continue
        words = block.word_hash[wa:wb]
        triples = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7)
        seen = [np.mean(words[1:] == words[:-1]), 1 - len(np.unique(triples)) / (n - 2), (1 - len(np.unique(words)) / n) ** 2]
        out[r, PAIRS : PAIRS + 3] = _REPEAT_WEIGHT * np.sqrt(seen)
    row, slot = word_slots(block)
    n = np.bincount(row, minlength=block.n)
    at, counts = np.unique(row * WORDS + slot, return_counts=True)
    row, slot = at // WORDS, at % WORDS
    out[row, PAIRS + 3 + slot] = _WORD_WEIGHT * np.sqrt(counts / n[row])
    return out


def word_slots(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed term of each word that has letters or digits."""
    letter = _LETTER[block.buf]
    place = np.r_[0, np.cumsum(letter)]
    a, b = place[block.ws], place[block.we]
    some = b > a
    a, b = a[some], b[some]
    sums = rolling(_VALUE[LOWER[block.buf[letter]]])
    value = mix((sums[b] - sums[a]) * powers(len(sums) + 1)[1][a] + (b - a).astype(U))
    return block.word_row()[some], (value % U(WORDS)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels, and the terms that are not zero with their places: what the driver gathers."""
    for batch in batches:
        for block in blocks(batch):
            y = batch.column("y").slice(block.first_row, block.n)
            own = [(np.flatnonzero(x), x) for x in terms(block)]
            yield pa.RecordBatch.from_arrays([y, pa.array([at.astype(np.uint16).tobytes() for at, _ in own], pa.binary()), pa.array([x[at].tobytes() for at, x in own], pa.binary())], ["y", "places", "terms"])


def _matrix(rows: pa.Table) -> np.ndarray:
    """The terms of gathered rows, a row for each."""
    x = np.zeros((rows.num_rows, TERMS), np.float32)
    for own, places, found in zip(x, rows.column("places"), rows.column("terms"), strict=True):
        own[np.frombuffer(places.as_py(), np.uint16)] = np.frombuffer(found.as_py(), np.float32)
    return x


class Votes:
    """The fitted latent space and its labelled vectors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float):
        self.share = share
        self.vectors = None
        if not len(x):
            return
        seen = (x > 0).sum(axis=0)
        self.weight = np.log1p(len(x) / (1 + seen)).astype(np.float32)
        weighted = x * self.weight
        self.mean = weighted.mean(axis=0)
        weighted -= self.mean
        _, axes = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))  # the right singular vectors, in little memory
        self.axes = axes[:, ::-1][:, : min(RANK, len(x))].astype(np.float32)
        some = x.any(axis=1)
        self.vectors, y = self._placed(weighted)[some], y[some]
        parts = np.array([1 - share, share])
        number = np.bincount(y, minlength=2)
        self.votes = (parts[y] / np.maximum(number[y], 1)).astype(np.float32)
        self.ones = y == 1

    def _placed(self, weighted: np.ndarray) -> np.ndarray:
        v = weighted @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def latent(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._placed(x * self.weight - self.mean), x.any(axis=1)

    def score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(x), self.share)
        if self.vectors is None or not len(self.vectors):
            return out
        latent, some = self.latent(x)
        for at in range(0, len(x), block):
            cosine = latent[at : at + block] @ self.vectors.T
            cosine -= cosine.max(axis=1, keepdims=True)  # the votes' scale cancels out
            weight = np.exp(SHARPNESS * cosine) * self.votes
            out[at : at + block] = (weight @ self.ones.astype(np.float32)) / weight.sum(axis=1)
        return np.clip(np.where(some, out, self.share), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Votes:
    allowed = remainder(5) != 0
    rows = training_sample(docs, labels, "quality", allowed, per_class).select("text", "y").mapInArrow(_features, "y int, places binary, terms binary").toArrow()
    return Votes(_matrix(rows), rows.column("y").to_numpy().astype(np.int64), share_of_ones(labels, "quality", allowed))


def scored(docs: DataFrame, model: Votes, name: str = "score") -> DataFrame:
    """All columns of docs and the score under ``name``, which no column of docs may have."""
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs has a column {name}: give the score another name")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                rows = batch.slice(block.first_row, block.n)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(shared.value.score(terms(block)))], [*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
