"""The thin queries over this package's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .chat_format import digests, with_control_row
from .curve_search import search
from .minhash_dedup import near_duplicates
from .mixing import mixture
from .quality_votes import quality
from .secret_linking import secrets
from .substring_dedup import remove_repeats
from .template_decontamination import contamination
from .toxicity_kernel import toxicity
from .warc_archive import archived

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("repeats")


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents"))


def op3_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages")).drop("file", "offset")


def op5_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(with_control_row(_table(spark, sf_dir, "conversations")))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_table(spark, sf_dir, "documents")).drop("text_key", "found")


def queries() -> dict[str, Query]:
    own = (op1_substring_dedup, op2_temperature_mixing, op3_toxicity_kernel, op4_warc_chain, op5_curve_search, op6_minhash_dedup, op7_chat_round_trip, op8_template_decontamination, op9_quality_votes, op10_secret_linking)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
