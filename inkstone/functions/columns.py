"""Columns over syllables and texts.

Sounds come from a generated reference table (424 syllables, five tones or none, with and
without the suffix, in every system), joined by broadcast: its size is fixed. What needs a
search or Unicode normalisation runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import phonology as p
from . import romanise
from .phonology import INVENTORY, Syllable

SYLLABLE = T.StructType([T.StructField("initial", T.StringType()), T.StructField("final", T.StringType()), T.StructField("tone", T.ByteType()), T.StructField("erhua", T.BooleanType()), T.StructField("original_tone", T.ByteType())])
READING = T.ArrayType(SYLLABLE)


def syllable_rows() -> list[tuple]:
    out = []
    for spelt in INVENTORY:
        for erhua in (False, True):
            for tone in (None, 1, 2, 3, 4, 5):
                s = p.parse(spelt)._replace(tone=tone, erhua=erhua)
                out.append((spelt, tone, erhua, s.initial, s.final, p.write(s), p.write(s, "numbers"), p.write(s, "superscript"), p.write(s, "none"), romanise.bopomofo(s), romanise.wade_giles(s), romanise.yale(s), romanise.gwoyeu(s), romanise.ipa(s)))
    return out


SYLLABLE_COLUMNS = "spelling string, tone int, erhua boolean, initial string, final string, marks string, numbers string, superscript string, toneless string, bopomofo string, wade_giles string, yale string, gwoyeu string, ipa string"


def syllable_table(spark: SparkSession) -> DataFrame:
    """Every syllable in every notation and system: 5088 rows."""
    return spark.createDataFrame(syllable_rows(), SYLLABLE_COLUMNS)


def with_syllables(df: DataFrame, spelling: str, tone: str, erhua: Column | None = None) -> DataFrame:
    """df and the reference table's columns for its spelling and tone."""
    table = syllable_table(df.sparkSession).withColumnsRenamed({"spelling": "_spelling", "tone": "_tone", "erhua": "_erhua"})
    own = F.lit(False) if erhua is None else erhua
    joined = df.join(F.broadcast(table), (F.col(spelling) == F.col("_spelling")) & F.col(tone).eqNullSafe(F.col("_tone")) & (own == F.col("_erhua")), "left")
    return joined.drop("_spelling", "_tone", "_erhua")


def candidate_table(spark: SparkSession, system: str) -> DataFrame:
    """(spelling, candidates): the toneless syllables that a spelling of the system stands for, in order."""
    spell = {"wade_giles": romanise.wade_giles_spelling, "yale": romanise.yale_spelling, "ipa": romanise.ipa_symbols}[system]
    out: dict[str, list[str]] = {}
    for x in INVENTORY:
        out.setdefault(spell(p.parse(x)), []).append(x)
    return spark.createDataFrame(list(out.items()), "spelling string, candidates array<string>")


def _udf(function: Callable, kind) -> Callable[..., Column]:
    """Null in, null out; equal values of a batch are computed once."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        known = {v: function(v) for v in values.dropna().unique()}
        return values.map(known).astype(object).where(values.notna(), None)

    return run


def _struct(s: Syllable | None):
    return None if s is None else dict(s._asdict())


def _list(found) -> list | None:
    return None if found is None else [_struct(s) for s in found]


def parse_syllable(text: Column) -> Column:
    """A written syllable as a struct; null for anything else."""
    return _struct_udf(lambda v: p.parse(v))(text)


def _struct_udf(function: Callable) -> Callable[..., Column]:
    @F.pandas_udf(SYLLABLE)
    def run(values: pd.Series) -> pd.DataFrame:
        found = [None if v is None else function(v) for v in values]
        rows = [s._asdict() if s else dict.fromkeys(SYLLABLE.names) for s in found]
        return pd.DataFrame(rows, columns=SYLLABLE.names, dtype=object)

    def column(text: Column) -> Column:
        read = run(text)
        return F.when(read["initial"].isNotNull(), read)

    return column


def split_word(text: Column) -> Column:
    return _udf(lambda v: None if (x := p.split_word(v)) is None else list(x), "array<string>")(text)


def read_word(text: Column) -> Column:
    return _udf(lambda v: _list(p.read_word(v)), READING)(text)


def apply_tone(text: Column, tone: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series, tones: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else p.mark(v, None if pd.isna(t) else int(t)) for v, t in zip(values, tones, strict=True)], dtype=object)

    return run(text, tone)


#: Every precomposed letter with a tone mark, and the letter without.
_MARKED = "".join(m for v in "aeiouüêAEIOUÜÊ" for m in (p.mark(v, t) for t in (1, 2, 3, 4)) if len(m) == 1)


def strip_marks(text: Column) -> Column:
    """Without tone marks; precomposed letters and combining marks alike."""
    bare = F.translate(text, _MARKED + "ńňǹḿ", "".join(p.strip_marks(c) for c in _MARKED) + "nnnm")
    return F.regexp_replace(bare, f"[{p._MARKS}]", "")


def tone_of_marks(text: Column) -> Column:
    by_tone = {t: "".join(c for c in _MARKED + "ńňǹḿ" if p.tone_of_marks(c) == t) + p._MARKS[t - 1] for t in (1, 2, 3, 4)}
    return F.coalesce(*(F.when(text.rlike(f"[{by_tone[t]}]"), F.lit(t)) for t in (1, 2, 3, 4)))


def transcribe(text: Column, system: str) -> Column:
    """A written pinyin word in a system; null if it isn't one."""
    return _udf(lambda v: None if (x := p.read_word(v)) is None else romanise.word(system, x), "string")(text)


def read_candidates(text: Column, system: str, tones: p.ToneTable = p.NO_TONES) -> Column:
    """Syllables, in numbers notation, that a spelling may stand for. system: wade_giles, wade_giles_loose, yale, gwoyeu, ipa or bopomofo."""
    readers = {
        "wade_giles": lambda v: romanise.read_wade_giles(v, tones=tones),
        "wade_giles_loose": lambda v: romanise.read_wade_giles(v, True, tones),
        "yale": lambda v: romanise.read_yale(v, tones),
        "gwoyeu": lambda v: romanise.read_gwoyeu(v, tones),
        "ipa": lambda v: romanise.read_ipa(v, tones),
        "bopomofo": lambda v: [s for s in [romanise.read_bopomofo(v)] if s],
    }
    return _udf(lambda v: [p.write(s, "numbers") for s in readers[system](v)], "array<string>")(text)


def opens_with_vowel(text: Column) -> Column:
    """Whether it begins with a, o or e, marked or not."""
    return text.rlike("^[aoeAOEāáǎàōóǒòēéěèĀÁǍÀŌÓǑÒĒÉĚÈ]")


def apostrophes_column(spellings: Column) -> Column:
    """An array of a word's syllables, an apostrophe before each inner one that begins with a, o or e."""
    return F.transform(spellings, lambda x, k: F.when((k > 0) & opens_with_vowel(x), F.concat(F.lit("'"), x)).otherwise(x))
