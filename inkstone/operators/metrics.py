"""Accuracy of written pinyin against an expected text: per-case counts in Arrow batches, then plain sums."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phonology import split_word, strip_marks

COUNTS = ("cases", "exact", "expected_syllables", "actual_syllables", "bases", "readings", "capitals", "boundary_hits", "expected_boundaries", "actual_boundaries")


def tokens(text: str) -> tuple[list[str], set[int]]:
    """A text's syllables and the places where words begin."""
    out, starts = [], set()
    for raw in text.split():
        word = re.sub(r"^(?:[^\w]|_)+|(?:[^\w]|_)+$", "", raw)
        if word:
            starts.add(len(out))
            out += split_word(word) or (word,)
    return out, starts


def comparable(s: str) -> str:
    return unicodedata.normalize("NFC", s.lower())


def toneless(s: str) -> str:
    return re.sub("[0-5]$", "", strip_marks(comparable(s)))


def alignment(expected: list[str], actual: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; where both ways are as long, the expected side moves on."""
    n, m = len(expected), len(actual)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if expected[i] == actual[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if expected[i] == actual[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def case_counts(expected: str, actual: str) -> tuple[int, ...]:
    (want, want_starts), (got, got_starts) = tokens(expected), tokens(actual)
    pairs = alignment([toneless(s) for s in want], [toneless(s) for s in got])
    back = {j: i for i, j in pairs}
    big = lambda s: s[:1] != s[:1].lower()
    readings = sum(comparable(want[i]) == comparable(got[j]) for i, j in pairs)
    capitals = sum(big(want[i]) == big(got[j]) for i, j in pairs)
    hits = sum(back.get(j) in want_starts for j in got_starts if j in back)
    return 1, int(expected.strip() == actual.strip()), len(want), len(got), len(pairs), readings, capitals, hits, len(want_starts), len(got_starts)


def scored(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """df with the ten counts of each row's case; null texts count as empty."""

    @F.pandas_udf(", ".join(f"{c} bigint" for c in COUNTS))
    def run(want: pd.Series, got: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([case_counts(a or "", b or "") for a, b in zip(want, got, strict=True)], columns=COUNTS)

    return df.withColumn("_c", run(expected, actual)).select(*df.columns, "_c.*")


def report(counts: DataFrame, *by: str) -> DataFrame:
    """Percentages from counts, in all or by groups; a ratio over nothing is 0."""
    sums = counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in COUNTS))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom == 0, 0.0).otherwise(100 * top / bottom)

    c = F.col
    longest = F.greatest("expected_syllables", "actual_syllables")
    precision, recall = ratio(c("boundary_hits"), c("actual_boundaries")), ratio(c("boundary_hits"), c("expected_boundaries"))
    spacing = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return sums.select(*by, ratio(c("exact"), c("cases")).alias("exact"), ratio(c("readings"), longest).alias("readings"), ratio(c("bases"), longest).alias("bases"), ratio(c("readings"), c("bases")).alias("tones"), ratio(c("capitals"), longest).alias("capitals"), spacing.alias("spacing"))
