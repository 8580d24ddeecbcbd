"""Streams: every text operator is stateless, so a streaming DataFrame takes the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.udf import Texts


def with_pinyin(stream: DataFrame, texts: Texts, text: str = "text", **options) -> DataFrame:
    """The batch or streaming rows and their pinyin."""
    return stream.withColumn("pinyin", texts.pinyin(F.col(text), **options))


def syllable_counts(stream: DataFrame, texts: Texts, time: str, window: str = "1 minute", late: str = "1 minute", text: str = "text") -> DataFrame:
    """How often each syllable is written in each window of event time; rows later than the watermark are left out."""
    pieces = stream.withWatermark(time, late).select(time, F.explode(texts.pieces(F.col(text), method="lattice")).alias("piece"))
    said = pieces.where("piece.syllable is not null")
    return said.groupBy(F.window(time, window), F.lower("piece.text").alias("syllable")).agg(F.count("*").alias("n"))
