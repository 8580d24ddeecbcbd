"""Substring dedup by prefix-partitioned, sparse suffix trees over words.

A suffix is a document read from one of its words on. Words that lie below a *deep internal
node* (a path of at least ``window`` words that two or more suffixes share) are repeats; the
first suffix of a node, in (doc_id, start) order, is kept.

1. *Sparse suffixes.* Of the ``window - prefix + 1`` suffix prefixes inside a window the one
   with the smallest hash is its anchor. Equal windows choose equal anchors at equal offsets,
   so only anchored suffixes (about one word in seven) are posted.
2. *Variable-length prefixes.* Anchored suffixes are counted by their ``prefix``-word prefix.
   A prefix with one suffix is a leaf and leaves the job with its windows, which is most of
   the text. One whose suffixes fit ``GROUP_BYTES`` is a group. A longer one is split: the
   suffixes that begin at its windows are counted by a prefix half-way to ``window`` words,
   and those that are still too many by one of ``window`` words, where all members of a group
   are equal.
3. *Subtrees.* A group's suffixes come with the words around them, as 40-bit hashes. They are
   sorted, and the words that neighbours share are the depths of the subtree's internal
   nodes. A window that begins j words before its anchor lies at the nodes of depth
   ``window - j``; there the members are told apart by the j words to their left, so a node
   that several left contexts reach (a maximal repeat) is divided into its windows. Of equal
   windows the first is kept and the others are repeats; neighbouring repeats join into the
   removed ranges.

Skew and memory: before an exchange a task keeps, of the suffixes it has gathered that are
equal with all their words, one, and sends the others directly to their documents, so a
passage that is in a third of all rows sends one posting per ``GATHER`` gathered, not one per
row. Partitions are as many as keep one to ``PARTITION_SUFFIXES`` postings, and a task builds
its subtrees some whole groups at a time. The prefixes that need splitting are broadcast;
each stands for more than ``GROUP_BYTES`` of postings, so they are few: 8 bytes for each 64
MB. Words are compared by hash: two windows that differ in a word are taken for equal with a
chance of 2**-40.

Null texts have no words. Rows without a doc_id take no part and give no row. A doc_id
that occurs in several rows stands for the row with the smallest text (a null text
counts as empty). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textblocks import Block, blocks, kgrams, longs, mix

WINDOW, PREFIX = 20, 8
GROUP_BYTES, GATHER, PARTITION_SUFFIXES, PARTITION_TEXT = 64 << 20, 1 << 16, 200_000, 192 << 20
WORD = 5  # bytes of a word's hash
U = np.uint64
_INDEX_BITS = 28
_COUNTED = pa.schema([("to", pa.int32()), ("labels", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary())])
_COUNTED_DDL = "to int, labels binary, docs binary, starts binary, counts binary"
_SUFFIXES = pa.schema([("to", pa.int32()), ("labels", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("masks", pa.binary()), ("words", pa.binary())])
_SUFFIXES_DDL = "to int, labels binary, docs binary, starts binary, masks binary, words binary"
_SPOTS = pa.schema([("doc_id", pa.int64()), ("spots", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("repeats", pa.list_(pa.list_(pa.int64())))])


def anchors(block: Block, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the block's windows, the anchor of each, and the prefix hashes."""
    grams, _ = block.grams(prefix)
    m = len(block.ws) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    row = block.word_row()
    starts = np.flatnonzero(row[:m] == row[window - 1 :])
    span = window - prefix + 1
    low = U((1 << _INDEX_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=U)
    width = 1
    while width < span:  # sliding minimum by doubling
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return starts, (least[starts] & low).astype(np.int64), grams


def _rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _runs(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1], True]).tolist() if len(sorted_keys) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _dealt(schema: pa.Schema, to: np.ndarray, *columns: np.ndarray | None) -> pa.RecordBatch:
    """One row for each partition dealt to, its postings packed; a column that is None stays null."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    runs = _runs(to)
    packed = [pa.nulls(len(runs), pa.binary()) if x is None else pa.array([x[order[a:b]].tobytes() for a, b in runs], pa.binary()) for x in columns]
    return _rows(schema, [to[[a for a, _ in runs]].astype(np.int32), *packed])


def _to_documents(schema: pa.Schema, n: int, doc: np.ndarray, start: np.ndarray, mask: np.ndarray | None = None) -> pa.RecordBatch:
    """Postings on their way to their documents have no labels."""
    empty = [None] * (len(schema) - 4)
    if mask is not None:
        empty[0] = mask.astype(np.int32)
    return _dealt(schema, (mix(doc.astype(U)) % U(n)).astype(np.int32), None, doc, start.astype(np.int32), *empty)


def _gathered(batches: Iterator[pa.RecordBatch], names: list[str], passed: list[pa.RecordBatch]) -> list[bytes]:
    """The partition's labelled columns, each joined; rows on their way to documents are put aside."""
    held: list[list[bytes]] = [[] for _ in names]
    for batch in batches:
        own = batch.column("labels").is_valid()
        if (other := batch.filter(pa.compute.invert(own))).num_rows:
            passed.append(other)
        for out, name in zip(held, names, strict=True):
            out += batch.filter(own).column(name).to_pylist()
    return [b"".join(x) for x in held]


# ---- counting prefixes ----------------------------------------------------------------
class _Counter:
    """A task's suffixes, gathered to a bounded number, then dealt out: the first of each label to the label's partition with the number of all, the others to their documents."""

    most = 1 << 20

    def __init__(self, n: int, wanted: bool = True):
        self.n, self.wanted, self.held, self.parts = n, wanted, 0, []

    def add(self, label: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((label, doc, start))
        self.held += len(doc)
        if self.held >= self.most:
            yield from self.deal()

    def deal(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        label, doc, start = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.held, self.parts = 0, []
        order = np.argsort(label, kind="stable")
        label, doc, start = label[order], doc[order], start[order]
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        count = np.diff(np.r_[first, len(label)])
        if self.wanted:
            known = np.repeat(count > 1, count)  # what repeats in this task repeats
            if known.any():
                yield _to_documents(_COUNTED, self.n, doc[known], start[known])
        one = label[first]
        yield _dealt(_COUNTED, (mix(one) % U(self.n)).astype(np.int32), _six(one), doc[first], start[first].astype(np.int32), count.astype(np.int32))


def _six(label: np.ndarray) -> np.ndarray:
    """A prefix's label in six bytes; a collision only costs work."""
    return np.ascontiguousarray(label).view(np.uint8).reshape(-1, 8)[:, :6]


def _short(label: np.ndarray) -> np.ndarray:
    return label & U((1 << 48) - 1)


def _of_six(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(U)[:, 0]


def _prefixes(window: int, prefix: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Counter(n)
        for batch in batches:
            ids = longs(batch, "doc_id")
            for block in blocks(batch):
                _, anchor, grams = anchors(block, window, prefix)
                at = np.unique(anchor)
                row = np.searchsorted(block.wo, at, "right") - 1
                yield from out.add(_short(grams[at]), ids[block.first_row + row], at - block.wo[row])
        yield from out.deal()

    return run


def _counted(n: int, most: int, wanted: bool):
    """Adds a partition's counts up: suffixes whose prefix repeats go to their documents, and prefixes of more than ``most`` suffixes are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        label, doc, start, count = _gathered(batches, ["labels", "docs", "starts", "counts"], passed)
        yield from passed
        label, doc, start, count = _of_six(label), np.frombuffer(doc, np.int64), np.frombuffer(start, np.int32), np.frombuffer(count, np.int32)
        if not len(label):
            return
        order = np.argsort(label, kind="stable")
        label, doc, start, count = label[order], doc[order], start[order], count[order]
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        size = np.diff(np.r_[first, len(label)])
        total = np.add.reduceat(count.astype(np.int64), first)
        several = np.repeat(total > 1, size) & (count == 1)  # those counted more often are with their documents
        if wanted and several.any():
            yield _to_documents(_COUNTED, n, doc[several], start[several])
        if (total > most).any():
            yield _rows(_COUNTED, [[0], [_six(label[first[total > most]]).tobytes()], [None], [None], [None]])

    return run


# ---- suffixes with their words --------------------------------------------------------
class _Suffixes:
    """A task's suffixes with their words, gathered to a bounded number, then dealt out: the first of equal ones to its group's partition, the others to their documents as repeats."""

    def __init__(self, n: int):
        self.n, self.held, self.parts = n, 0, []

    def add(self, label: np.ndarray, doc: np.ndarray, start: np.ndarray, mask: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(doc), GATHER):
            self.parts.append([x[at : at + GATHER] for x in (label, doc, start, mask, words)])
            self.held += len(self.parts[-1][0])
            if self.held >= GATHER:
                yield from self.deal()

    def deal(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        label, doc, start, mask, words = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.held, self.parts = 0, []
        own = [mix(mix((words ^ U(salt)) * _ODD[: words.shape[1]]).sum(axis=1, dtype=U) + mask.astype(U)) for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A99)]
        order = np.lexsort((start, doc, own[1], own[0], label))
        same = np.ones(len(order), bool)
        same[0] = False
        for key in (label, *own):
            same[1:] &= key[order[1:]] == key[order[:-1]]
        again, first = order[same], order[~same]
        if len(again):
            yield _to_documents(_SUFFIXES, self.n, doc[again], start[again], mask[again])
        raw = np.ascontiguousarray(words[first]).view(np.uint8).reshape(len(first), words.shape[1], 8)[:, :, :WORD]
        yield _dealt(_SUFFIXES, (mix(label[first]) % U(self.n)).astype(np.int32), _six(label[first]), doc[first], start[first].astype(np.int32), mask[first].astype(np.int32), raw)


_ODD = mix(np.arange(1, 257, dtype=U)) | U(1)


def _in(labels: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which labels are in the sorted array."""
    if not len(of):
        return np.zeros(len(labels), bool)
    return of[np.minimum(np.searchsorted(of, labels), len(of) - 1)] == labels


def _contexts(block: Block, at: np.ndarray, mask: np.ndarray, window: int, left: int) -> np.ndarray:
    """The words around each suffix that the windows of its mask cover, ``left`` of them before it; 0 stands for the others."""
    words = block.word_hash >> U(64 - 8 * WORD)
    place = np.arange(-left, window)
    span = np.arange(left + 1)
    held = (mask[:, None] >> span) & 1 > 0
    most = left - np.argmax(held[:, ::-1], axis=1)  # the largest and smallest offset of a window
    least = np.argmax(held, axis=1)
    index = at[:, None] + place
    inside = (place >= -most[:, None]) & (place < window - least[:, None])
    return np.where(inside, words[np.clip(index, 0, len(words) - 1)], U(0))


def _crowded(block: Block, spots: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and anchors of the windows whose anchor's prefix repeats, and the prefix hashes."""
    starts, anchor, grams = anchors(block, window, prefix)
    crowded = np.zeros(len(block.ws) + 1, bool)
    for r in range(block.n):
        own = np.frombuffer(spots[block.first_row + r], np.int32)
        crowded[block.wo[r] + own[own < block.n_words[r]]] = True  # a place of another row of the doc_id may lie behind this one's end
    some = crowded[anchor]
    return starts[some], anchor[some], grams


def _longer(window: int, prefix: int) -> int:
    return prefix + (window - prefix + 1) // 2


def _longer_prefixes(window: int, prefix: int, n: int, over):
    """The longer prefixes of the windows under prefixes of too many suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Counter(n, wanted=False)
        for batch in batches:
            ids, spots = longs(batch, "doc_id"), batch.column("spots").to_pylist()
            for block in blocks(batch):
                starts, anchor, grams = _crowded(block, spots, window, prefix)
                starts = starts[_in(_short(grams[anchor]), over.value)]
                longer, _ = block.grams(_longer(window, prefix))
                row = np.searchsorted(block.wo, starts, "right") - 1
                yield from out.add(_short(longer[starts]), ids[block.first_row + row], starts - block.wo[row])
        yield from out.deal()

    return run


def _suffixes(window: int, prefix: int, n: int, over, over_longer):
    """Suffixes with their words: anchored ones where their prefix is a group, else one for each window, under its longer prefix."""
    left = window - prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Suffixes(n)
        for batch in batches:
            ids, spots = longs(batch, "doc_id"), batch.column("spots").to_pylist()
            for block in blocks(batch):
                starts, anchor, grams = _crowded(block, spots, window, prefix)
                if not len(starts):
                    continue
                split = _in(_short(grams[anchor]), over.value)
                at, of = np.unique(anchor[~split], return_inverse=True)
                mask = np.zeros(len(at), np.int64)
                np.add.at(mask, of, np.int64(1) << (anchor[~split] - starts[~split]))
                label = _short(grams[at])
                if split.any():
                    alone = starts[split]
                    longer, whole = _short(block.grams(_longer(window, prefix))[0][alone]), _short(mix(block.grams(window)[0][alone]))
                    label = np.r_[label, np.where(_in(longer, over_longer.value), whole, longer)]
                    at, mask = np.r_[at, alone], np.r_[mask, np.ones(len(alone), np.int64)]
                for lot in range(0, len(at), GATHER):
                    some = at[lot : lot + GATHER]
                    row = np.searchsorted(block.wo, some, "right") - 1
                    yield from out.add(label[lot : lot + GATHER], ids[block.first_row + row], some - block.wo[row], mask[lot : lot + GATHER], _contexts(block, some, mask[lot : lot + GATHER], window, left))
        yield from out.deal()

    return run


def subtree_repeats(label: np.ndarray, doc: np.ndarray, start: np.ndarray, mask: np.ndarray, words: np.ndarray, window: int, left: int) -> np.ndarray:
    """For each suffix, the offsets (a mask) of its windows that an earlier suffix of its group has as well.

    The suffixes are sorted by group and words; the number of words that neighbours share
    is the depth of the internal node that parts them.
    """
    right = words[:, left:]
    order = np.lexsort((*right.T[::-1], label))
    ranked = right[order]
    share = np.zeros(len(order), np.int64)  # with the suffix before
    share[1:] = np.logical_and.accumulate(ranked[1:] == ranked[:-1], axis=1).sum(axis=1)
    share[1:][label[order[1:]] != label[order[:-1]]] = -1
    share[:1] = -1
    out = np.zeros(len(order), np.int64)
    context = np.zeros(len(order), U)  # of the words to the left
    for j in range(left + 1):
        if j:
            context = mix(context * U(0x9E3779B97F4A7C15) + words[:, left - j] + U(1))
        node = np.cumsum(share < window - j)  # nodes of this depth, and leaves
        own = mask[order] >> j & 1 > 0
        size = np.bincount(node[own], minlength=node[-1] + 1)
        own &= size[node] > 1
        some = order[own]
        if not len(some):
            continue
        place, sides = node[own], context[some]
        rank = np.lexsort((start[some], doc[some], sides, place))
        some, place, sides = some[rank], place[rank], sides[rank]
        again = (place[1:] == place[:-1]) & (sides[1:] == sides[:-1])
        out[some[1:][again]] |= 1 << j
    return out


def _subtrees(window: int, prefix: int, n: int):
    left = window - prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        label, doc, start, mask, raw = _gathered(batches, ["labels", "docs", "starts", "masks", "words"], passed)
        yield from passed
        label, doc, start, mask = _of_six(label), np.frombuffer(doc, np.int64), np.frombuffer(start, np.int32), np.frombuffer(mask, np.int32).astype(np.int64)
        raw = np.frombuffer(raw, np.uint8).reshape(-1, left + window, WORD)
        order = np.argsort(label, kind="stable")
        bounds = np.flatnonzero(np.r_[True, label[order[1:]] != label[order[:-1]], True]) if len(order) else np.zeros(1, int)
        size = np.diff(bounds)
        at = 0
        while at < len(size):  # whole groups, some at a time
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GATHER, "right")) - 1)
            own = order[bounds[at] : bounds[stop]]
            own = own[np.repeat(size[at:stop], size[at:stop]) > 1]
            at = stop
            if not len(own):
                continue
            words = np.zeros((len(own), left + window, 8), np.uint8)
            words[:, :, :WORD] = raw[own]
            again = subtree_repeats(label[own], doc[own], start[own], mask[own], words.view(U)[:, :, 0], window, left)
            if (some := again > 0).any():
                yield _to_documents(_SUFFIXES, n, doc[own][some], start[own][some], again[some])

    return run


def _documents(span: int):
    """A row for each document of the partition: its places, packed; those with masks stand for a window for each offset in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, starts, masks = [b""], [b""], [b""]
        for batch in batches:
            docs += batch.column("docs").to_pylist()
            starts += batch.column("starts").to_pylist()
            if span:
                masks += batch.column("masks").to_pylist()
        doc, start = np.frombuffer(b"".join(docs), np.int64), np.frombuffer(b"".join(starts), np.int32)
        if span:
            mask = np.frombuffer(b"".join(masks), np.int32)
            lots = [(doc[some], start[some] - np.int32(j)) for j in range(span) for some in (np.flatnonzero(mask >> j & 1),)]
            doc, start = (np.concatenate(x) for x in zip(*lots, strict=True))
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order].astype(np.int32)
        runs = _runs(doc)
        yield _rows(_SPOTS, [doc[[a for a, _ in runs]], pa.array([start[a:b].tobytes() for a, b in runs], pa.binary())])

    return run


def cover(block: Block, row: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words of the row lie in a window that begins at one of the starts."""
    n = int(block.n_words[row])
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + window, n), -1)
    return np.cumsum(steps[:-1]) > 0


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column("spots").to_pylist()
            for block in blocks(batch):
                gone = np.zeros(len(block.ws), bool)
                repeats: list[list[list[int]]] = [[] for _ in range(block.n)]
                for r in range(block.n):
                    if part := spots[block.first_row + r]:
                        lost = cover(block, r, np.frombuffer(part, np.int32), window)
                        gone[block.wo[r] : block.wo[r + 1]] = lost
                        edge = np.flatnonzero(np.diff(np.r_[0, lost.astype(np.int8), 0]))
                        repeats[r] = edge.reshape(-1, 2).tolist()
                kept = np.flatnonzero(~gone)
                row = block.word_row()[kept]
                ends = block.we[kept] + 1  # with the blank after it
                last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
                ends[last] -= 1
                steps = np.zeros(len(block.buf) + 2, np.int8)
                np.add.at(steps, block.ws[kept], 1)
                np.add.at(steps, ends, -1)
                take = np.cumsum(steps[: len(block.buf)], dtype=np.int8) > 0
                text = block.buf.copy()
                text[(text == 32) | ((text >= 9) & (text <= 13))] = 32
                size = np.r_[0, np.cumsum(take)][block.off]
                out = text[take].tobytes()
                shas = [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(size[:-1], size[1:], strict=True)]
                removed = np.r_[0, np.cumsum(gone)]
                yield _rows(_RESULT, [batch.column("doc_id").slice(block.first_row, block.n), block.n_words, removed[block.wo[1:]] - removed[block.wo[:-1]], shas, repeats])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word ranges (maximal repeats) of each document.

    A word goes if a window of ``window`` words over it also starts earlier: in a
    document with a smaller doc_id, or earlier in the same one.
    """
    spark = docs.sparkSession
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-(named.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0) // PARTITION_TEXT))
    texts = named.groupBy("doc_id").agg(F.min("text").alias("text")).repartition(n, "doc_id")
    most = GROUP_BYTES // (20 + WORD * (2 * window - prefix))

    def over(counted: DataFrame):
        """The prefixes of more than ``most`` suffixes: fewer than the suffixes divided by that."""
        raw = b"".join(r[0] for r in counted.where("labels is not null").select("labels").collect())
        return spark.sparkContext.broadcast(np.unique(_of_six(raw)))

    # counted over all rows as they lie, so that texts are moved once, later; rows that share a doc_id only add prefixes
    counted = cut(named.mapInArrow(_prefixes(window, prefix, n), _COUNTED_DDL).repartitionById(n, "to").mapInArrow(_counted(n, most, True), _COUNTED_DDL))
    crowded = counted.where("labels is null")
    split = over(counted)
    spots = texts.join(crowded.repartitionById(n, "to").mapInArrow(_documents(0), "doc_id bigint, spots binary"), "doc_id")
    split_longer = split
    if len(split.value):
        longer = spots.mapInArrow(_longer_prefixes(window, prefix, n, split), _COUNTED_DDL)
        split_longer = over(longer.repartitionById(n, "to").mapInArrow(_counted(n, most, False), _COUNTED_DDL))

    n = max(n, -(-(crowded.agg(F.sum(F.octet_length("docs").cast("bigint"))).first()[0] or 0) // (8 * PARTITION_SUFFIXES)))
    posted = spots.mapInArrow(_suffixes(window, prefix, n, split, split_longer), _SUFFIXES_DDL)
    found = posted.repartitionById(n, "to").mapInArrow(_subtrees(window, prefix, n), _SUFFIXES_DDL)
    again = found.repartitionById(n, "to").mapInArrow(_documents(window - prefix + 1), "doc_id bigint, spots binary")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, repeats array<array<bigint>>"
    return texts.join(again, "doc_id", "left").mapInArrow(_kept(window), schema)
