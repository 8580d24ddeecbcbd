"""Benchmark decontamination over typed templates.

*Canonical form.* Words are cut to their letters and digits, in lower case. Typed slots
replace what a re-parameterised question changes: a word with a digit is a number, a
listed unit after a number is a unit, and a capitalised word is a name (wherever it
stands, so the slot does not depend on the text around a passage). A second form keeps
names as words, for copies whose case was changed.

*Template windows* of five words are hashed and joined: a benchmark of at most
``BROADCAST_WINDOWS`` windows is sent to all tasks as one sorted array; for a larger one,
only the rarest windows of each item, so many that a document which holds the item shares
one, are joined with the documents' windows, and the pairs that meet are matched like the
others. A bit array of fixed size keeps all other windows out of that join. A document holds an item if it has at least 80 %
of the item's distinct windows in either form; items of fewer words than a window are one
window of their own length.

A window of slots alone says nothing, so such a window keeps its values and meets copies only.
Changed values would lose it, so an item with other windows, too, is also held by 80 % of
those alone; what only windows of slots cover must then have the same types of slots where
the nearest alignment puts it. ``matched``, ``windows`` and ``share`` are those of all
windows where these suffice, else of the windows with words.

*Slot consistency.* Matched windows are put side by side along the document's nearest
alignment; an item's slot value must stand for one value of the document throughout, and
different values for different ones. The share of slot places that agree must reach 80 %,
and at least half of the item's matched words must be the same words, else the overlap is
a coincidence of templates and is not reported. Matches whose values differ are
``reparameterised``, the others ``copy``.

Null and empty texts match nothing; items without words are no items. Rows without a
doc_id or item_id take no part. A doc_id or item_id that occurs in several rows stands for
the union of their matches (one row a pair). Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut
from .textblocks import LOWER, Block, blocks, flat, kgrams, longs, mix, powers, rolling

WINDOW, SHARE, SAME, BROADCAST_WINDOWS = 5, 0.8, 0.5, 4_000_000
SIEVE_BITS = 1 << 27
UNITS = "mm cm m km mi ft in g kg mg lb oz l ml s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros usd eur cent cents mph kmh mile miles meter meters metre metres foot feet inch inches pound pounds gram grams litre litres liter liters".split()
U = np.uint64
_NUMBER, _UNIT, _NAME = U(0xA5A5A5A5A5A5A501), U(0xA5A5A5A5A5A5A502), U(0xA5A5A5A5A5A5A503)
_RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int64()), ("windows", pa.int64()), ("share", pa.float64()), ("agreement", pa.float64()), ("kind", pa.string())])
_RESULT_DDL = "doc_id bigint, item_id bigint, matched bigint, windows bigint, share double, agreement double, kind string"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Tokens:
    """A block's words in canonical form: hashes of the values and of both template forms, and row bounds."""

    def __init__(self, block: Block):
        buf = block.buf
        low = LOWER[buf]
        accent = np.zeros(len(buf), bool)  # capitals of the Latin-1 letters: second byte of C3 80 to C3 9E
        accent[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[accent] += 32
        capital = accent | ((buf >= 65) & (buf <= 90))
        small = (buf >= 97) & (buf <= 122) | ((buf >= 0xA0) & (buf < 0xC0) & ~accent)
        letter = _LETTER[buf]
        digit = (buf >= 48) & (buf <= 57)

        def counts(flag: np.ndarray) -> np.ndarray:
            total = np.r_[0, np.cumsum(flag)]
            return total[block.we] - total[block.ws]

        some = counts(letter)
        place = np.r_[0, np.cumsum(letter)]
        lead = np.flatnonzero(letter)
        first = lead[np.minimum(place[block.ws], max(len(lead) - 1, 0))] if len(lead) else np.zeros(len(block.ws), int)
        opens = capital[first] | np.r_[capital[1:], False][first] & (buf[first] == 0xC3) if len(lead) else np.zeros(len(block.ws), bool)
        keep = some > 0
        sums = rolling(MIXED[low[letter]])
        a, b = place[block.ws][keep], place[block.we][keep]
        inverse = powers(len(sums) + 1)[1]
        self.value = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U))
        number = counts(digit)[keep] > 0
        name = (opens & (counts(small) > 0))[keep] & ~number
        row = block.word_row()[keep]
        after = np.r_[False, number[:-1] & (row[1:] == row[:-1])] if len(row) else np.zeros(0, bool)
        unit = after & np.isin(self.value, UNIT_HASHES) & ~number
        self.plain = np.where(number, _NUMBER, np.where(unit, _UNIT, self.value))
        self.named = np.where(name & ~unit, _NAME, self.plain)
        self.slot = number | unit | name
        self.wo = np.searchsorted(row, np.arange(block.n + 1))
        self.row = row
        self.forms = ((self.named, self.slot), (self.plain, number | unit))

    def windows(self, form: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the form's k-word windows, which lie in one row, and which are slots alone; those keep their values."""
        codes, slot = self.forms[form]
        grams, whole = kgrams(codes, self.wo, k)
        bare = np.zeros(len(grams), bool)
        if len(grams):
            slots = np.r_[0, np.cumsum(slot)]
            bare = slots[k:] - slots[:-k] == k
            if bare.any():
                grams = np.where(bare, kgrams(self.value, self.wo, k)[0], grams)
        return grams, whole, bare


MIXED = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
UNIT_HASHES = np.zeros(0, U)


def _block_of(texts: list[str]) -> Block:
    buf, off = flat(pa.array(texts, pa.string()))
    return Block(0, buf[off[0] : off[-1]], off - off[0])


UNIT_HASHES = np.sort(Tokens(_block_of(UNITS)).value)


class Templates:
    """The benchmark's windows: sorted hashes and where each stands (form, item, place)."""

    def __init__(self, ids: np.ndarray, texts: list[str]):
        tokens = Tokens(_block_of(texts)) if len(texts) else None
        self.ids, self.value, self.slot, self.start = ids, np.zeros(0, U), np.zeros(0, bool), np.zeros(1, int)
        entries = []  # hash, form, item, place, words, whether slots alone
        self.total: dict[tuple[int, int], int] = {}
        self.worded: dict[tuple[int, int], int] = {}  # windows that are not slots alone
        self.forms = tokens.forms if tokens is not None else ()
        if tokens is not None:
            self.value, self.slot, self.start = tokens.value, tokens.slot, tokens.wo
            size = np.diff(tokens.wo)
            for form in (0, 1):
                for k in range(1, WINDOW + 1):
                    grams, whole, bare = tokens.windows(form, k)
                    at = np.flatnonzero(whole)
                    item = tokens.row[at]
                    own = size[item] == k if k < WINDOW else size[item] >= k
                    at, item = at[own], item[own]
                    entries.append((grams[at], np.full(len(at), form), item, at - tokens.wo[item], np.full(len(at), k), bare[at]))
                    for number, some in ((self.total, np.ones(len(at), bool)), (self.worded, ~bare[at])):
                        pairs = np.unique(np.stack([item[some].astype(U), grams[at[some]]], axis=1), axis=0)
                        number.update({(form, int(i)): int(n) for i, n in zip(*np.unique(pairs[:, 0], return_counts=True), strict=True)})
        joined = [np.concatenate(x) for x in zip(*entries, strict=True)] if entries else [np.zeros(0, U), *[np.zeros(0, int)] * 4, np.zeros(0, bool)]
        order = np.argsort(joined[0], kind="stable")
        self.hash, self.form, self.item, self.place, self.words, self.bare = (x[order] for x in joined)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hash & U((1 << 20) - 1)).astype(np.int64)] = True
        self.lengths = sorted({int(k) for k in np.unique(self.words)})

    def hits(self, tokens: Tokens) -> np.ndarray:
        """(row, form, item, place in the item, place in the row, words, entry) of equal windows."""
        out = []
        for form in (0, 1):
            for k in self.lengths:
                grams, whole, _ = tokens.windows(form, k)
                at = np.flatnonzero(self.filter[(grams & U((1 << 20) - 1)).astype(np.int64)] & whole)
                low, high = np.searchsorted(self.hash, grams[at], "left"), np.searchsorted(self.hash, grams[at], "right")
                at, low, n = at[high > low], low[high > low], (high - low)[high > low]
                entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else np.zeros(0, int)
                at = np.repeat(at, n)
                own = (self.form[entry] == form) & (self.words[entry] == k)
                at, entry = at[own], entry[own]
                row = tokens.row[at]
                out.append(np.stack([row, np.full(len(at), form), self.item[entry], self.place[entry], at - tokens.wo[row], np.full(len(at), k), entry], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 7), int)

    def matches(self, tokens: Tokens) -> dict[tuple[int, int], tuple[int, int, float, str]]:
        """(row, item) -> matched windows, windows, agreement, kind: by all windows rather than by those with words, and the better of the two forms."""
        hits = self.hits(tokens)
        out: dict[tuple[int, int], tuple[int, int, float, str]] = {}
        rank: dict[tuple[int, int], tuple[bool, float]] = {}
        if not len(hits):
            return out
        order = np.lexsort((hits[:, 4], hits[:, 3], hits[:, 1], hits[:, 2], hits[:, 0]))
        hits = hits[order]
        cuts = np.flatnonzero(np.r_[True, (hits[1:, :3] != hits[:-1, :3]).any(axis=1), True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            row, form, item = (int(x) for x in hits[a, :3])
            own = hits[a:b]
            bare = self.bare[own[:, 6]]
            for every, total, used in ((True, self.total[(form, item)], own), (False, self.worded.get((form, item), 0), own[~bare])):
                if not total or len(used) < SHARE * total or not every and total == self.total[(form, item)]:
                    continue
                matched = len(np.unique(self.hash[used[:, 6]]))
                if matched < SHARE * total:
                    continue
                agreement, same, changed = self.agreement(tokens, used, row, item, None if every else form)
                if agreement >= SHARE and same >= SAME and (every, matched / total) >= rank.get((row, item), (False, 0.0)):
                    rank[(row, item)] = (every, matched / total)
                    out[(row, item)] = (matched, total, agreement, "reparameterised" if changed else "copy")
                    break
        return out

    def agreement(self, tokens: Tokens, own: np.ndarray, row: int, item: int, form: int | None = None) -> tuple[float, float, bool]:
        """Share of slot places that fit one substitution of values, share of words that are the same, and whether any value changed.

        With a form, places that only its windows of slots alone cover count as well.
        """
        main = Counter((own[:, 4] - own[:, 3]).tolist()).most_common(1)[0][0]
        pairs: dict[int, tuple[int, int]] = {}  # place in the item -> distance, place in the row
        for place, at, k in own[:, 3:6].tolist():
            far = abs(at - place - main)
            for j in range(k):
                if place + j not in pairs or far < pairs[place + j][0]:
                    pairs[place + j] = (far, at + j)
        values = {p: (int(self.value[self.start[item] + p]), int(tokens.value[tokens.wo[row] + q])) for p, (_, q) in pairs.items()}
        missed = 0  # places without their type of slot
        for p in self.covered_by_slots(item, form) if form is not None else ():
            if p in values:
                continue
            q = p + main
            i, j = self.start[item] + p, tokens.wo[row] + q
            if 0 <= q and j < tokens.wo[row + 1] and self.forms[form][0][i] == tokens.forms[form][0][j]:
                values[p] = (int(self.value[i]), int(tokens.value[j]))
            else:
                missed += 1
        same = sum(x == y for x, y in values.values()) / (len(values) + missed)
        seen = [values[p] for p in values if self.slot[self.start[item] + p]]
        forth: dict[int, Counter] = defaultdict(Counter)
        back: dict[int, Counter] = defaultdict(Counter)
        for x, y in seen:
            forth[x][y] += 1
            back[y][x] += 1
        fits = sum(forth[x].most_common(1)[0][0] == y and back[y].most_common(1)[0][0] == x for x, y in seen)
        return fits / (len(seen) + missed) if seen else 1.0, same, missed > 0 or any(x != y for x, y in seen)

    def covered_by_slots(self, item: int, form: int) -> list[int]:
        """Places of the item all of whose windows in the form are slots alone."""
        a, b = int(self.start[item]), int(self.start[item + 1])
        words = np.r_[0, np.cumsum(~self.forms[form][1][a:b])]
        p = np.arange(b - a)
        return p[words[np.minimum(p + WINDOW, b - a)] == words[np.maximum(p - WINDOW + 1, 0)]].tolist()


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, matched, windows, share, agreement, kind."""
    spark = docs.sparkSession
    items = _items(benchmark)
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    words = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if words <= 2 * most:  # a window has two characters at least, its blank included
        rows = items.toArrow()
        order = np.argsort(rows.column("item_id").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        found = own.mapInArrow(_looked_up(spark.sparkContext.broadcast(Templates(rows.column("item_id").to_numpy(), rows.column("text").to_pylist()))), _RESULT_DDL)
    else:
        found = _joined(own, items)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "agreement", "matched", "windows", "kind")).alias("m"))
    return best.select("doc_id", "item_id", "m.matched", "m.windows", "m.share", "m.agreement", "m.kind")


def _found(ids: np.ndarray, item_ids: np.ndarray, matches: dict) -> pa.RecordBatch:
    rows = [(int(ids[r]), int(item_ids[i]), m, t, m / t, a, kind) for (r, i), (m, t, a, kind) in matches.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)


def _looked_up(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = shared.value
        for batch in batches:
            ids = longs(batch, "doc_id")
            for block in blocks(batch):
                found = templates.matches(Tokens(block))
                if found:
                    yield _found(ids[block.first_row :], templates.ids, found)

    return run


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item row's distinct windows: item_id, row, form, words, window, and whether it is slots alone."""
    for batch in batches:
        for block in blocks(batch):
            tokens = Tokens(block)
            size = np.diff(tokens.wo)
            for form in (0, 1):
                for k in range(1, WINDOW + 1):
                    grams, whole, bare = tokens.windows(form, k)
                    at = np.flatnonzero(whole)
                    at = at[size[tokens.row[at]] == k if k < WINDOW else size[tokens.row[at]] >= k]
                    rows = np.unique(np.stack([tokens.row[at].astype(U), _keyed(grams[at], form, k), bare[at].astype(U)], axis=1), axis=0)
                    of = pa.array(block.first_row + rows[:, 0].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column("item_id").take(of), batch.column("row").take(of), pa.array(np.full(len(rows), form), pa.int32()), pa.array(np.full(len(rows), k), pa.int32()), pa.array(rows[:, 1].view(np.int64)), pa.array(rows[:, 2] == 1)], ["item_id", "row", "form", "words", "window", "bare"])


def _keyed(grams: np.ndarray, form: int, k: int) -> np.ndarray:
    """Window hashes that only windows of the same form and length share."""
    return mix(grams + U(8 * form + k))


def _document_windows(lengths: list[int], sieve):
    """Distinct (doc_id, window) in both forms, of the lengths that the benchmark has and let through by the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sieve.value
        for batch in batches:
            ids = longs(batch, "doc_id")
            for block in blocks(batch):
                tokens = Tokens(block)
                for form in (0, 1):
                    for k in lengths:
                        grams, whole, _ = tokens.windows(form, k)
                        at = np.flatnonzero(whole)
                        key = _keyed(grams[at], form, k)
                        place = key & U(SIEVE_BITS - 1)
                        some = held[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8) & 1 > 0
                        rows = np.unique(np.stack([ids[block.first_row + tokens.row[at[some]]].view(U), key[some]], axis=1), axis=0).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["doc_id", "window"])

    return run


def _sieve(windows: DataFrame) -> np.ndarray:
    """A bit for each of ``SIEVE_BITS`` hash values that some window has: a fixed size, whatever the benchmark's."""
    place = F.col("window").bitwiseAND(F.lit(SIEVE_BITS - 1))
    piece = SIEVE_BITS // 128

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(piece, bool)
        bits[rows.column("place").to_numpy() % piece] = True
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    found = windows.select(place.alias("place")).distinct().withColumn("piece", F.floor(F.col("place") / piece).cast("int")).groupBy("piece").applyInArrow(run, "piece int, bits binary")
    out = np.zeros(SIEVE_BITS // 8, np.uint8)
    for at, bits in found.collect():  # 128 rows at most
        out[at * piece // 8 : (at + 1) * piece // 8] = np.frombuffer(bits, np.uint8)
    return out


def _prefixes(items: DataFrame) -> DataFrame:
    """(item_id, words, window): so many of each item's rarest windows that whatever holds the item shares one.

    For each row and form: holding SHARE of n windows leaves out n - ceil(SHARE * n) at
    most, so one more than that are enough; likewise among the windows with words, by
    which an item may be held as well.
    """
    own = cut(items.withColumn("row", F.md5("text")).mapInArrow(_item_windows, "item_id bigint, row string, form int, words int, window bigint, bare boolean"))
    often = own.groupBy("window").agg(F.count("*").alias("often"))
    every, alike = Window.partitionBy("item_id", "row", "form"), Window.partitionBy("item_id", "row", "form", "bare")
    placed = own.join(often, "window").select(
        "item_id", "words", "window", "bare",
        F.row_number().over(every.orderBy("often", "window")).alias("at"), F.count("*").over(every).alias("n"),
        F.row_number().over(alike.orderBy("often", "window")).alias("at_alike"), F.count("*").over(alike).alias("n_alike"),
    )
    spare = lambda n: n - F.ceil(F.lit(SHARE) * n) + 1
    return placed.where((F.col("at") <= spare(F.col("n"))) | ~F.col("bare") & (F.col("at_alike") <= spare(F.col("n_alike")))).select("item_id", "words", "window").distinct()


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For benchmarks of any size: documents and items that share a window of an item's prefix meet, then match as above."""
    prefixes = cut(_prefixes(items))
    lengths = sorted(r[0] for r in prefixes.select("words").distinct().collect())  # WINDOW numbers at most
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(prefixes))
    met = docs.mapInArrow(_document_windows(lengths, sieve), "doc_id bigint, window bigint").join(prefixes.select("item_id", "window"), "window").select("doc_id", "item_id").distinct()
    pairs = met.join(docs, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # one set of templates a batch, of its distinct items, for its distinct documents
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            some, own = (table.select(names).group_by(names).aggregate([]) for names in (["item_id", "item"], ["doc_id", "text"]))
            templates = Templates(some.column("item_id").to_numpy(), some.column("item").to_pylist())
            for part in own.combine_chunks().to_batches():
                ids = longs(part, "doc_id")
                for block in blocks(part):
                    if found := templates.matches(Tokens(block)):
                        yield _found(ids[block.first_row :], templates.ids, found)

    return pairs.mapInArrow(run, _RESULT_DDL)
