"""MinHash near-dedup by a signature-coordinate inverted join.

1. A document is the set of its distinct 5-word shingles, sketched by ``COORDINATES``
   minima. Documents with equal sets form one class (128-bit set fingerprint), so exact
   copies, however many, are one row from here on.
2. *Prefix merging.* Sets with similarity of the threshold agree in at least ``matches``
   coordinates (but for a chance of ``MISS``), so they agree in one of any
   ``COORDINATES - matches + 1``. Only these are posted, under (coordinate, value).
3. *Skip merging.* The postings carry the signatures. A list is merged from its smallest
   member on: each probe counts collisions over all coordinates at once with those not
   reached yet, and what it reaches is skipped as a partner from then on. A list emits a
   spanning forest of its pairs over the match threshold, never all its pairs.
4. Components of these candidates are the units of the exact check, on full sets: a unit
   is cut into parts of bounded size; a small one is its own hub set, a large one is
   compared with a few hubs, and then what the hubs did not reach, in blocks of hubs, with
   all of it. Only pairs with 100 * intersection >= 85 * union link.

Null texts and texts without words have an empty set and link with nothing. Rows without
a doc_id take no part and give no row; of rows that repeat a doc_id the one with the
smallest set fingerprint stands. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import components, cut, of_groups
from .textblocks import Block, blocks, longs, mix

COORDINATES, MISS, SHINGLE = 32, 1e-7, 5
PART, PARTITION_POSTINGS = 256, 1_000_000
HUBS = 8
U = np.uint64
_SEEDS = np.random.Generator(np.random.PCG64(97)).integers(1, 2**63, COORDINATES, dtype=np.uint64) * U(2) + U(1)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("shingles", pa.binary()), ("signature", pa.binary())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_POSTINGS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("reps", pa.binary()), ("signatures", pa.binary())])


def matches_needed(share: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most collisions that sets of this similarity reach but for a chance of ``miss``."""
    below = 0.0
    for k in range(coordinates + 1):
        below += comb(coordinates, k) * share**k * (1 - share) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def shingle_sets(block: Block, k: int = SHINGLE) -> list[np.ndarray]:
    """Distinct k-word shingle hashes of each row; a shorter text is one shingle."""
    grams, _ = block.grams(k)
    out = []
    for r in range(block.n):
        a, b = int(block.wo[r]), int(block.wo[r + 1])
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], U)
            for w in block.word_hash[a:b]:
                whole = mix(whole * U(31) + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, U))
    return out


def fingerprint(shingles: np.ndarray) -> bytes | None:
    """128 bits that equal sets share; none for the empty set."""
    return np.array([mix(shingles).sum(dtype=U), mix(shingles ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], U).tobytes() if len(shingles) else None


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, U)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, np.multiply.outer(shingles[at : at + 4096], _SEEDS).min(axis=0), out=least)
    return (mix(least) >> U(32)).astype(np.uint32)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = longs(batch, "doc_id")
        for block in blocks(batch, lower=True):
            sets = shingle_sets(block)
            prints = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids[block.first_row : block.first_row + block.n]), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], schema=_SKETCH)


def _postings(posted: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reps = longs(batch, "rep")
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            keys = (sig[:, :posted].astype(U) << U(8)) | np.arange(posted, dtype=U)
            of = np.repeat(np.arange(len(reps)), posted)
            keys = keys.reshape(-1)
            bucket = (mix(keys) % U(n)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = np.split(order, edge)
            yield pa.RecordBatch.from_arrays([pa.array([bucket[p[0]] for p in parts], pa.int32()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([reps[of[p]].tobytes() for p in parts], pa.binary()), pa.array([sig[of[p]].tobytes() for p in parts], pa.binary())], schema=_POSTINGS)

    return run


def forest(reps: np.ndarray, sig: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """A spanning forest of the list's pairs that collide in enough coordinates; trees hang on their smallest member."""
    order = np.argsort(reps)
    reps, sig = reps[order], sig[order]
    out, rest = [], np.arange(len(reps))
    while len(rest) > 1:
        root, front = rest[0], [rest[0]]
        rest = rest[1:]
        while front and len(rest):
            hit = (sig[rest] == sig[front.pop()]).sum(axis=1) >= matches
            front += rest[hit].tolist()
            out += [(int(reps[root]), int(reps[x])) for x in rest[hit]]
            rest = rest[~hit]
    return out


def _merged(matches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, reps, sig = [b""], [b""], [b""]
        for batch in batches:
            for out, name in ((keys, "keys"), (reps, "reps"), (sig, "signatures")):
                out += batch.column(name).to_pylist()
        key, rep = np.frombuffer(b"".join(keys), U), np.frombuffer(b"".join(reps), np.int64)
        signed = np.frombuffer(b"".join(sig), np.uint32).reshape(-1, COORDINATES)
        del keys, reps, sig
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True]) if len(key) else np.zeros(1, int)
        found: set[tuple[int, int]] = set()
        sizes = np.diff(cuts)
        for at in np.flatnonzero(sizes > 1):
            own = order[cuts[at] : cuts[at + 1]]
            found.update(forest(rep[own], signed[own], matches))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_EDGES)

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, lower=True):
            sets = shingle_sets(block)
            rows = batch.slice(block.first_row, block.n)
            out = pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("unit"), rows.column("parts"), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "unit", "parts", "members"])
            yield out.filter(pa.array([fingerprint(s) == x for s, x in zip(sets, rows.column("shingles").to_pylist(), strict=True)], pa.bool_()))


def similar(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sorted sets have 100 * intersection >= percent * union with this one."""
    if not others:
        return np.zeros(0, bool)
    size = np.array([len(x) for x in others])
    everything = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, everything), len(own) - 1)
    shared = np.add.reduceat(own[at] == everything, np.r_[0, np.cumsum(size)[:-1]])
    return 100 * shared >= percent * (len(own) + size - shared)


def _exact(percent: int, matches: int):
    """Links of one part of a unit with the unit's hubs; hubs that are members merge by skipping."""

    def run(_key, hubs: pa.Table, members: pa.Table) -> pa.Table:
        rep = members.column("rep").to_numpy()
        sets = [np.frombuffer(x, U) for x in members.column("members").to_pylist()]
        sig = np.array([signature(s) for s in sets]).reshape(-1, COORDINATES)
        hub_rep = hubs.column("hub").to_numpy()
        out = []
        where = {int(r): i for i, r in enumerate(rep)}
        if len(rep) and set(hub_rep.tolist()) == where.keys():  # the unit is this part
            rest = np.argsort(rep)
            while len(rest) > 1:
                root, front, rest = rest[0], [rest[0]], rest[1:]
                while front and len(rest):
                    x = front.pop()
                    near = rest[(sig[rest] == sig[x]).sum(axis=1) >= matches]
                    hit = near[similar(sets[x], [sets[i] for i in near], percent)]
                    front += hit.tolist()
                    out += [(int(rep[root]), int(rep[i])) for i in hit]
                    rest = rest[~np.isin(rest, hit)]
        else:
            tree = np.arange(len(rep))  # members that some hub has joined share a number; a hub joins each tree by one edge
            for r, own in zip(hub_rep, hubs.column("hub_members").to_pylist(), strict=True):
                own = np.frombuffer(own, U)
                near = np.flatnonzero((sig == signature(own)).sum(axis=1) >= matches)
                hit = near[similar(own, [sets[i] for i in near], percent)]
                joined, first = np.unique(tree[hit], return_index=True)
                out += [(int(r), int(rep[i])) for i in hit[first] if rep[i] != r]
                if len(joined):
                    tree[np.isin(tree, joined)] = joined[0]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, schema=_EDGES)

    return run


def _links(hubs: DataFrame, members: DataFrame, percent: int, matches: int) -> DataFrame:
    """Verified (a, b): each block of a unit's hubs against every part of it."""
    last = (F.col("blocks") - 1).cast("int")
    dealt = members.select("unit", "rep", "members", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), last)).alias("block"))
    spread = hubs.select(F.col("unit").alias("hub_unit"), F.col("rep").alias("hub"), F.col("members").alias("hub_members"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("hub_block"), F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("hub_part"))
    pair = spread.groupBy("hub_unit", "hub_block", "hub_part").cogroup(dealt.groupBy("unit", "block", "part"))
    return pair.applyInArrow(_exact(percent, matches), "a bigint, b bigint")


def judged(docs: DataFrame) -> DataFrame:
    """The rows with a doc_id; of rows that repeat one, that whose set near_duplicates compares (of equal sets the smallest text)."""
    own = docs.where("doc_id is not null")
    repeated = own.groupBy("doc_id").count().where("count > 1").select("doc_id")
    several = own.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, lower=True):
                prints = [fingerprint(s) for s in shingle_sets(block)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(block.first_row, block.n), pa.array(prints, pa.binary())], ["row", "shingles"])

    drawn = several.mapInArrow(run, T.StructType([several.schema["row"], T.StructField("shingles", T.BinaryType())]))
    first = F.min_by("row", F.struct("shingles", "row.text", F.to_json("row")))
    chosen = drawn.groupBy(F.col("row.doc_id").alias("of")).agg(first.alias("row")).select("row.*")
    return own.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(chosen)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept of each document."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    matches = matches_needed(percent / 100)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    drawn = docs.mapInArrow(_sketches, "doc_id bigint, n_shingles bigint, shingles binary, signature binary")
    sketches = cut(drawn.groupBy("doc_id").agg(F.min(F.struct("shingles", "n_shingles", "signature")).alias("s")).select("doc_id", "s.*"))
    classes = sketches.where("n_shingles > 0").groupBy("shingles").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    classes = cut(classes)

    n = max(n, -(-classes.count() * (COORDINATES - matches + 1) // PARTITION_POSTINGS))  # a task holds its partition's postings
    posted = classes.select("rep", "signature").mapInArrow(_postings(COORDINATES - matches + 1, n), "bucket int, keys binary, reps binary, signatures binary")
    candidates = posted.repartitionById(n, "bucket").mapInArrow(_merged(matches), "a bigint, b bigint")
    units = components(candidates).select(F.col("node").alias("doc_id"), F.col("component").alias("unit"))
    sizes = units.groupBy("unit").agg(F.count("*").alias("size"), F.ceil(F.count("*") / PART).alias("parts"))
    wanted = cut(of_groups(units, cut(sizes), "unit").join(classes.select(F.col("rep").alias("doc_id"), "shingles"), "doc_id"))
    members = cut(docs.join(wanted, "doc_id").mapInArrow(_full_sets, "rep bigint, unit bigint, parts bigint, members binary"))

    large = members.where("parts > 1")
    few = large.groupBy("unit", (F.pmod(F.xxhash64(F.col("rep"), F.lit(1)), F.lit(HUBS))).alias("slot")).agg(F.min_by("rep", F.xxhash64("rep")).alias("rep")).select("rep")
    hubs = members.where("parts = 1").unionByName(large.join(few, "rep", "left_semi"))
    one = F.lit(1).cast("bigint")
    links = cut(_links(hubs.withColumn("blocks", one), members.withColumn("blocks", one), percent, matches))
    found = components(links)
    if not large.isEmpty():  # what no hub has reached is compared with all of its unit
        reached = large.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("unit", "rep", "members", "parts", F.coalesce("component", "rep").alias("component"))
        main = reached.groupBy("unit", "component").count().groupBy("unit").agg(F.max_by("component", "count").alias("main"), F.ceil((F.sum("count") - F.max("count")) / PART).alias("blocks"), F.sum("count").alias("size"))
        compared = of_groups(reached, cut(main.where("blocks > 0")), "unit")
        found = components(links.unionByName(_links(compared.where("component <> main"), compared, percent, matches)))

    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("shingles", F.coalesce("component", "rep").alias("component"))
    of = sketches.select("doc_id", "n_shingles", "shingles").join(named, "shingles", "left")
    of = of.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return of.withColumn("kept", F.col("doc_id") == F.col("component_id"))
