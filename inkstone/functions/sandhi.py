"""Tone sandhi: the third tone, and 一 and 不, over a run of syllables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phonology import NEUTRAL, Syllable, spelling

_POWERS = frozenset(("shi", "bai", "qian", "wan"))


def _third(out: list[Syllable], places) -> None:
    for k in places:
        if out[k].tone == 3 and out[k + 1].tone == 3:
            out[k] = out[k].toned(2)


def third_tone(syllables: list[Syllable], grouping: list | None = None) -> list[Syllable]:
    """Third tones before third tones become second: inside constituents, then between a word's two, then a lone syllable before the next word.

    grouping: a size for each word, or sizes of its constituents; ignored where the sizes
    don't add up to the syllables.
    """
    out = list(syllables)
    words = [[w] if isinstance(w, int) else list(w) for w in grouping or []]
    if grouping is None or sum(map(sum, words)) != len(out):
        _third(out, range(len(out) - 1))
        return out
    inner, joints, lone, at = [], [], [], 0
    for number, parts in enumerate(words):
        start = at
        for k, size in enumerate(parts):
            inner += range(at, at + size - 1)
            at += size
            if k < len(parts) - 1:
                joints.append(at - 1)
        if at - start == 1 and number < len(words) - 1:
            lone.append(at - 1)
    for places in (inner, joints, lone):
        _third(out, places)
    return out


def _counts(out: list[Syllable], k: int) -> bool:
    """Whether this 一 counts something: not an ordinal's, nor a digit at the end of a larger number."""
    before = spelling(out[k - 1]) if k else ""
    after = spelling(out[k + 1]) if k + 1 < len(out) else ""
    return before != "di" and (before not in _POWERS or after in _POWERS or after == "ling")


def yi_bu(syllables: list[Syllable]) -> list[Syllable]:
    out = list(syllables)
    for k, s in enumerate(out):
        following = out[k + 1].tone if k + 1 < len(out) else None
        if s.sound() == ("", "i") and s.tone == 1:
            if _counts(out, k):
                out[k] = s.toned(1 if following in (None, NEUTRAL) else 2 if following == 4 else 4)
        elif s.sound() == ("b", "u") and s.tone == 4 and following == 4:
            out[k] = s.toned(2)
    return out


def apply(syllables, yi_bu_on: bool = True, third: bool = False, grouping: list | None = None) -> list[Syllable]:
    out = third_tone(list(syllables), grouping) if third else list(syllables)
    return yi_bu(out) if yi_bu_on else out


def third_tone_column(spellings: Column) -> Column:
    """Third tones before third tones become second, each read from its unchanged neighbour; syllables in numbers notation."""
    follows = lambda k: F.coalesce(F.get(spellings, k + 1), F.lit(""))
    return F.transform(spellings, lambda x, k: F.when(x.endswith("3") & follows(k).endswith("3"), F.regexp_replace(x, "3$", "2")).otherwise(x))


def yi_bu_column(spellings: Column) -> Column:
    """The 一 and 不 rules over an array of syllables in numbers notation, such as array('bu4', 'shi4')."""

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, "[0-5]$", "")

    def at(k: Column) -> Column:
        return F.when((k >= 0) & (k < F.size(spellings)), F.get(spellings, k)).otherwise("")

    def one(x: Column, k: Column) -> Column:
        before, after = bare(at(k - 1)), bare(at(k + 1))
        tone = F.right(at(k + 1), F.lit(1))
        powers = [F.lit(p) for p in sorted(_POWERS)]
        counts = (before != "di") & (~before.isin(*powers) | after.isin(*powers, F.lit("ling")))
        yi = F.when(tone == "4", "yi2").when(tone.isin("1", "2", "3"), "yi4").otherwise("yi1")
        return F.when((x == "yi1") & counts, yi).when((x == "bu4") & (tone == "4"), "bu2").otherwise(x)

    return F.transform(spellings, one)
