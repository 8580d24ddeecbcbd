"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

*Temperature.* A source with token share p gets weight p**t / sum(p**t); t = 1 keeps the
shares, t = 0 makes all sources equal, a larger t favours the large ones. t is the smallest
exponent in [0, ``MOST_EXPONENT``] whose mix neither exceeds the target entropy (a share of
log(sources)) nor repeats any source more than ``max_passes`` times within the budget, found
by section search. Each round evaluates 64 exponents in one map-side combined aggregate; no
source list is collected, however many sources there are.

Targets that no exponent meets: sources whose shares cannot be told apart keep their
entropy, so t stays 1; the repetition limit stands whatever t is, as no quota is more than
``max_passes`` times its source, so the mix then has fewer tokens than the budget.
``report`` says of each source what it was to get and what it got.

*Blocks.* A source of n tokens and a quota of T tokens is read in whole passes and one
partial pass. Each pass is a block: a permutation of the source's documents by a hash of
(seed, pass, doc_id). The partial pass never exceeds the rest of the quota: documents longer
than the rest are left out, the others are taken in permuted order while they fit, and
``FILLS`` - 1 times again from those that fit what is left then. So a source has a row
wherever its quota holds its shortest document. Running token sums come from per-bucket sums
(a bucket is a slice of the permutation, of ``BUCKET`` documents or, in large sources, the
square root of their number), so no source, however hot, is one task's documents.
``mix_order``, the share of its source's quota that stands before a document, interleaves
all sources: rows sorted by it hold the target mixture in every prefix.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have none and are in no
block. A null source counts as the source with the empty name. Rows without a doc_id take
no part; rows that repeat a doc_id count once, with the smallest (source, tokens). Extra
columns are ignored. A table without tokens gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

TARGET_ENTROPY, MAX_PASSES, BUCKET, GRID, ROUNDS, SEED = 0.95, 4.0, 4096, 64, 5, 17
MOST_EXPONENT, FILLS, BROADCAST_SOURCES = 16.0, 2, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def exponent(shares: DataFrame, budget: float, total: float, target: float, max_passes: float) -> float:
    """The smallest exponent within the entropy target and the repetition limit, as far as they can be met.

    shares: a column p, one row for each source. Rounded up to 10**-6, so that the last
    bits of the sums, which depend on the order of addition, don't show.
    """
    least, most, count = shares.agg(F.min("p"), F.max("p"), F.count("*")).first()
    if not count or most - least < 1e-9:  # no exponent changes the mix
        return 1.0

    def enough(t: float, z: float, h: float) -> bool:
        entropy = math.log(z) - t * h / z
        passes = least ** (t - 1) / z * budget / total  # of the smallest source; those of the others are no more while t < 1
        return entropy <= target * math.log(count) + 1e-12 and (t >= 1 or passes <= max_passes + 1e-12)

    def least_in(low: float, high: float) -> float | None:
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
            sums = shares.agg(*(F.sum(F.pow("p", F.lit(t))).alias(f"z{k}") for k, t in enumerate(grid)), *(F.sum(F.pow("p", F.lit(t)) * F.log("p")).alias(f"h{k}") for k, t in enumerate(grid))).first()
            first = next((k for k, t in enumerate(grid) if enough(t, sums[f"z{k}"], sums[f"h{k}"])), None)
            if first is None:
                return None
            low, high = grid[max(first - 1, 0)], grid[first]
            if first == 0 or high - low < 1e-6:
                break
        return math.ceil(high * 1e6) / 1e6

    for low, high in ((0.0, 1.0), (1.0, MOST_EXPONENT)):
        if (t := least_in(low, high)) is not None:
            return t
    return 1.0


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, source and n_tokens of every document with tokens."""
    counted = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("n_tokens"))
    once = counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d"))
    return once.select("doc_id", "d.source", "d.n_tokens").where("n_tokens > 0")


def plan(sized: DataFrame, budget: int | None = None, target: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES) -> DataFrame:
    """A row for each source: source_tokens, source_docs, weight, quota, whole passes and the rest of the quota."""
    sources = cut(sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_docs")))
    total = sources.agg(F.sum("source_tokens")).first()[0] or 0
    budget = total if budget is None else budget
    share = F.col("source_tokens") / F.lit(float(max(total, 1)))
    t = exponent(sources.select(share.alias("p")), float(budget), float(max(total, 1)), target, max_passes)
    raw = F.pow(share, F.lit(t))
    norm = sources.agg(F.sum(raw)).first()[0] or 1.0
    weight = F.round(raw / F.lit(norm), 9)
    quota = F.floor(F.least(weight * F.lit(float(budget)), F.lit(float(max_passes)) * F.col("source_tokens"))).cast("bigint")
    out = sources.select("source", "source_tokens", "source_docs", weight.alias("weight"), quota.alias("quota"))
    passes = F.floor(F.col("quota") / F.col("source_tokens")).cast("bigint")
    return out.withColumn("passes", passes).withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_tokens"))


def _with_plan(sized: DataFrame, own: DataFrame) -> DataFrame:
    """Documents with their source's plan; the sources of most documents, ``BROADCAST_SOURCES`` at most, are sent to them.

    So the shuffled join of the others, on the source, meets no hot key.
    """
    if own.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return sized.join(F.broadcast(own), "source")
    large = cut(own.orderBy(F.desc("source_docs"), "source").limit(BROADCAST_SOURCES))
    names = F.broadcast(large.select("source"))
    return sized.join(F.broadcast(large), "source").unionByName(sized.join(names, "source", "left_anti").join(own.join(names, "source", "left_anti"), "source"))


def _running(blocks: DataFrame) -> DataFrame:
    """The blocks with ``until``: tokens of the block up to each document's end, in permuted order."""
    key = Window.partitionBy("source", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("source", "block", "bucket").agg(F.sum("n_tokens").alias("held")).select("source", "block", "bucket", F.coalesce(F.sum("held").over(key), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "block", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.withColumn("until", F.sum("n_tokens").over(within)).join(starts, ["source", "block", "bucket"])
    return placed.withColumn("until", F.col("until") + F.col("start")).drop("start")


def mixture(docs: DataFrame, budget: int | None = None, target: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """A row for each use of a document: source, block, doc_id, n_tokens, mix_order, and the source's weight.

    budget: tokens of the mix, all tokens of the input by default.
    """
    sized = cut(tokens(docs))
    return _uses(sized, cut(plan(sized, budget, target, max_passes)), seed)


def report(docs: DataFrame, budget: int | None = None, target: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """A row for each source with tokens: its weight and quota, and the tokens and documents' uses that the mixture has of it."""
    sized = cut(tokens(docs))
    own = cut(plan(sized, budget, target, max_passes))
    got = _uses(sized, own, seed).groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("uses"))
    return own.select("source", "source_tokens", "weight", "quota").join(got, "source", "left").fillna(0, ["mixed_tokens", "uses"])


def _uses(sized: DataFrame, own: DataFrame, seed: int) -> DataFrame:
    buckets = F.ceil(F.least(F.col("source_docs") / BUCKET, F.sqrt("source_docs")))
    blocks = _with_plan(sized, own.withColumn("buckets", buckets)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))))
    place = F.xxhash64(F.lit(seed), "block", "doc_id")
    bucket = F.pmod(F.shiftrightunsigned(place, 20), F.col("buckets")).cast("bigint")
    blocks = blocks.select("source", "block", "doc_id", "n_tokens", "weight", "quota", "source_tokens", "passes", "rest", place.alias("place"), bucket.alias("bucket"))
    columns = ["doc_id", "source", "block", "n_tokens", ((F.col("block") * F.col("source_tokens") + F.col("until") - F.col("n_tokens")) / F.col("quota")).alias("mix_order"), "weight"]

    out = _running(blocks.where("block < passes")).select(*columns)
    left = blocks.where("block = passes and n_tokens <= rest").withColumn("room", F.col("rest"))
    for turn in range(FILLS):
        placed = _running(left.where("n_tokens <= room")).withColumn("until", F.col("until") + F.col("rest") - F.col("room"))
        placed = cut(placed) if turn < FILLS - 1 else placed
        taken = placed.where("until <= rest")
        out = out.unionByName(taken.select(*columns))
        if turn < FILLS - 1:
            room = F.col("rest") - F.coalesce("filled", F.lit(0))
            held = taken.groupBy("source").agg(F.max("until").alias("filled"))
            over = placed.where("until > rest").drop("until", "room")
            left = over.join(F.broadcast(held) if held.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else held, "source", "left").withColumn("room", room).drop("filled")
    return out
