"""A training corpus from raw documents: five stages, each on what its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as
Parquet and rereads it as the next stage's docs. All but the last return the columns of
documents.

1. quality classifier: documents whose score is below the threshold go.
2. MinHash near-dedup: of each group of near duplicates the smallest doc_id stays.
   Documents without words are in no group and stay. Of rows that repeat a doc_id the
   one that was judged stands.
3. benchmark decontamination: documents that hold a benchmark item go.
4. secret scans: documents stay; every span found is replaced by ``[kind]`` in the text,
   and n_chars follows it.
5. mixing: what is left is drawn to the target mixture; a row for each use of a document.

Rows without a doc_id are in no group and stay at stage 2; stage 3 knows them by their
text. They leave at stage 5, whose rows name documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.minhash_dedup import judged, near_duplicates
from inkstone.llm.mixing import mixture
from inkstone.llm.quality_votes import THRESHOLD, fit, scored
from inkstone.llm.secret_linking import masked
from inkstone.llm.shared import folder, remove
from inkstone.llm.template_decontamination import contamination


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = "score"
    while name in map(str.lower, docs.columns):  # a column of the documents' own stays as it is
        name += "_"
    return scored(docs, fit(docs, labels), name).where(F.col(name) >= THRESHOLD).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs).where("kept").select("doc_id")
    named = judged(docs).join(kept, "doc_id", "left_semi").select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = docs.join(contamination(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    unnamed = docs.where("doc_id is null")
    if unnamed.isEmpty():
        return out
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    held = contamination(unnamed.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("held")).distinct()
    return out.where("doc_id is not null").unionByName(unnamed.join(held, key == F.col("held"), "left_anti"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return masked(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("mixing", mixing_stage),
]

#: The classifier, signatures and the fitted exponent are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared checkpoint folder and reread; a stage's table goes once the next is written, the last when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = folder(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before is not None:  # its successor is written, so nothing reads it any more
            remove(spark, before)
        before = f"{base}/{name}"
    return docs
