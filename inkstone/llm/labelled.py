"""Bounded training samples of labelled documents, and the held-out marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``; null where doc_id is null."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, max_bytes: int | None = None) -> DataFrame:
    """(text, y): at most ``per_class`` documents of each label, chosen by a hash of their id.

    ``allowed`` says which doc_ids may teach; labels other than 0 and 1 teach nothing. A
    doc_id with several labels counts with the largest. With ``max_bytes`` the documents are
    drawn among those with a text of so many bytes at most. The chosen ids, two classes of
    ``per_class`` at most, are what is broadcast.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    if max_bytes is not None:
        texts = texts.where(F.octet_length("text") <= max_bytes)
        known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("doc_id", "text", "y")


def share_of_ones(labels: DataFrame, label: str, allowed: Column) -> float:
    """Share of label 1 among all rows that may teach; 0.5 without any."""
    share = labels.where(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if share is None else float(share)
