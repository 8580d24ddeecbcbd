"""Mandarin syllables: sounds, pinyin spelling, tone marks, and splitting words into syllables.

A syllable is its sound (initial, underlying final), a tone (None: not written; 5:
neutral), and whether it carries the r suffix. The inventory is the phonotactic chart
below: for each final, the initials that it is attested with.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from typing import NamedTuple


class Syllable(NamedTuple):
    initial: str
    final: str
    tone: int | None = None
    erhua: bool = False
    original_tone: int | None = None

    def toned(self, tone: int | None) -> Syllable:
        return self._replace(tone=tone)

    def sound(self) -> tuple[str, str]:
        return self.initial, self.final


NEUTRAL = 5
#: Initials, two-letter ones first, and all finals in underlying form.
INITIALS = tuple("zh ch sh b p m f d t n l g k h j q x r z c s".split())
FINALS = tuple("a o e ê er ai ei ao ou an en ang eng ong i ia ie iao iou ian in iang ing iong u ua uo uai uei uan uen uang ueng ü üe üan ün io m n ng".split())
#: Attested initials of each final; 0 is no initial.
CHART = {
    "a": "0 b p m f d t n l g k h zh ch sh z c s",
    "o": "0 b p m f l",
    "e": "0 m d t n l g k h zh ch sh r z c s",
    "ê": "0",
    "er": "0",
    "ai": "0 b p m d t n l g k h zh ch sh z c s",
    "ei": "0 b p m f d t n l g k h zh sh z c s",
    "ao": "0 b p m d t n l g k h zh ch sh r z c s",
    "ou": "0 p m f d t n l g k h zh ch sh r z c s",
    "an": "0 b p m f d t n l g k h zh ch sh r z c s",
    "en": "0 b p m f d n g k h zh ch sh r z c s",
    "ang": "0 b p m f d t n l g k h zh ch sh r z c s",
    "eng": "0 b p m f d t n l g k h zh ch sh r z c s",
    "ong": "b d t n l g k h zh ch r z c s",
    "i": "0 b p m d t n l j q x zh ch sh r z c s",
    "ia": "0 d l j q x",
    "ie": "0 b p m d t n l j q x",
    "iao": "0 b p m f d t n l j q x",
    "iou": "0 m d n l j q x",
    "ian": "0 b p m d t n l j q x",
    "in": "0 b p m d n l j q x",
    "iang": "0 b n l j q x",
    "ing": "0 b p m d t n l j q x",
    "iong": "0 j q x",
    "u": "0 b p m f d t n l g k h zh ch sh r z c s",
    "ua": "0 g k h zh ch sh r",
    "uo": "0 d t n l g k h zh ch sh r z c s",
    "uai": "0 g k h zh ch sh",
    "uei": "0 d t g k h zh ch sh r z c s",
    "uan": "0 d t n l g k h zh ch sh r z c s",
    "uen": "0 d t n l g k h zh ch sh r z c s",
    "uang": "0 g k h zh ch sh",
    "ueng": "0",
    "ü": "0 n l j q x",
    "üe": "0 n l j q x",
    "üan": "0 j q x",
    "ün": "0 j q x",
    "io": "0",
    "m": "0 h",
    "n": "0",
    "ng": "0 h",
}
#: Attested in a few words only; they come after all others where candidates are listed.
RARE = tuple("bong cei din eng fiao lo rua sei tei".split())
_PALATAL = ("j", "q", "x")
_SHORT = {"iou": "iu", "uei": "ui", "uen": "un"}
_MARKS = "̄́̌̀"
_RAISED = "⁰¹²³⁴⁵"


def _alone(final: str) -> str:
    """Spelling of a final without an initial: y, w and yu take the place of i, u and ü."""
    if final[0] == "i":
        return {"i": "yi", "iou": "you", "in": "yin", "ing": "ying"}.get(final, "y" + final[1:])
    if final[0] == "u":
        return {"u": "wu", "uei": "wei", "uen": "wen"}.get(final, "w" + final[1:])
    return "yu" + final[1:] if final[0] == "ü" else final


def spelling(syllable: Syllable) -> str:
    """Toneless pinyin."""
    initial, final = syllable.sound()
    if not initial:
        body = _alone(final)
    elif initial in _PALATAL and final[0] == "ü":
        body = initial + "u" + final[1:]
    else:
        body = initial + _SHORT.get(final, final)
    return body + ("r" if syllable.erhua else "")


def _pronounceable() -> dict[str, tuple[str, str]]:
    """Every spelling that the rules can write, attested or not."""
    out: dict[str, tuple[str, str]] = {}
    for final in FINALS:
        for initial in ("", *INITIALS):
            if initial and final == "er":
                continue
            if initial in _PALATAL and final in ("u", "ua", "uo", "uan", "uen", "uai", "uang", "ueng", "uei") and final in ("u", "uan", "uen"):
                continue  # written alike, these are ü, üan and ün
            out.setdefault(spelling(Syllable(initial, final)), (initial, final))
    return out


_SOUNDS = _pronounceable()
for _row in ("ue",):  # after j q x, ue is the spelling of üe only
    for _p in _PALATAL:
        _SOUNDS[_p + _row] = (_p, "üe")


def strip_marks(text: str) -> str:
    """Without the four tone marks; the dots of ü stay."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if c not in _MARKS))


def tone_of_marks(text: str) -> int | None:
    """Tone of the marks in the text; the first tone's mark counts before the others'."""
    apart = unicodedata.normalize("NFD", text)
    return next((k for k, mark in enumerate(_MARKS, 1) if mark in apart), None)


def mark(text: str, tone: int | None) -> str:
    """The toneless text with the tone's mark: on a, o or e, else on the last of i u ü ê, else on m or n."""
    plain = strip_marks(text)
    low = plain.lower()
    if tone is None or tone == NEUTRAL:
        return plain
    at = next((low.index(v) for v in "aoe" if v in low), -1)
    if at < 0:
        at = max(low.rfind(v) for v in "iuüê")
    if at < 0:
        at = min((low.index(v) for v in "mn" if v in low), default=-1)
    return plain if at < 0 else unicodedata.normalize("NFC", plain[: at + 1] + _MARKS[tone - 1] + plain[at + 1 :])


def unify_umlaut(text: str) -> str:
    return text.replace("u:", "ü").replace("v", "ü").replace("V", "Ü")


def lower_digits(text: str) -> str:
    """Raised tone digits as plain ones."""
    return text.translate({ord(c): str(k) for k, c in enumerate(_RAISED)})


@cache
def parse(text: str) -> Syllable | None:
    """A syllable written with marks, a digit 0 to 5 (0 is neutral too) or raised digits; None for anything else."""
    body = lower_digits(unicodedata.normalize("NFC", unify_umlaut(text.strip())))
    digit = None
    if body and body[-1] in "012345":
        body, digit = body[:-1], int(body[-1]) or NEUTRAL
    marked = tone_of_marks(body)
    if not body or digit is not None and marked is not None:
        return None
    tone = marked if digit is None else digit
    low = strip_marks(body).lower()
    if low in _SOUNDS:
        return Syllable(*_SOUNDS[low], tone)
    if low.endswith("r") and low[:-1] in _SOUNDS:
        return Syllable(*_SOUNDS[low[:-1]], tone, True)
    return None


@cache
def write(syllable: Syllable, notation: str = "marks") -> str:
    """In marks, numbers, superscript or none; a tone that isn't written stays unwritten."""
    spelt = spelling(syllable)
    if notation == "marks":
        return mark(spelt, syllable.tone)
    if notation == "none" or syllable.tone is None:
        return spelt
    return spelt + (str(syllable.tone) if notation == "numbers" else _RAISED[syllable.tone])


def _inventory() -> tuple[str, ...]:
    known = sorted(spelling(Syllable("" if i == "0" else i, f)) for f, row in CHART.items() for i in row.split())
    return tuple([s for s in known if s not in RARE] + list(RARE))


INVENTORY = _inventory()
_KNOWN = frozenset(INVENTORY)


@cache
def opens_with_vowel(text: str) -> bool:
    """Whether it needs an apostrophe inside a word: it begins with a, o or e."""
    return strip_marks(text)[:1].lower() in ("a", "o", "e") and bool(text)


def _segmented(run: str, strict: bool, known: dict) -> tuple[str, ...] | None:
    if not run:
        return ()
    if run not in known:
        known[run] = None
        for end in range(len(run), 0, -1):
            one = parse(run[:end])
            if one is None or strict and (spelling(one._replace(erhua=False)) not in _KNOWN or opens_with_vowel(run[end:])):
                continue
            rest = _segmented(run[end:], strict, known)
            if rest is not None:
                known[run] = (run[:end], *rest)
                break
    return known[run]


@cache
def split_word(word: str) -> tuple[str, ...] | None:
    """Syllables of a written word: the longest first, attested ones that need no apostrophe if possible."""
    out: list[str] = []
    for run in re.split("['’‘-]", word):
        found = _segmented(run, True, {})
        if found is None:
            found = _segmented(run, False, {})
        if found is None:
            return None
        out += found
    return tuple(out) or None


def read_word(word: str) -> tuple[Syllable, ...] | None:
    parts = split_word(word)
    return None if parts is None else tuple(parse(p) for p in parts)


def apostrophes(spellings: list[str], style: str = "always") -> list[str]:
    """A word's syllables with apostrophes before inner a, o, e; ``standard`` leaves them out where the word splits alike without."""
    marked = ["'" + s if k and opens_with_vowel(s) else s for k, s in enumerate(spellings)]
    if style == "never" or marked == list(spellings):
        return list(spellings)
    return list(spellings) if style == "standard" and split_word("".join(spellings)) == tuple(spellings) else marked


class ToneTable:
    """Which tones each spelling is written in; a parameter, collected from a dictionary's readings."""

    def __init__(self, pairs=()):
        self.tones: dict[str, set[int]] = {}
        for spelt, tone in pairs:
            self.tones.setdefault(spelt, set()).add(tone)

    def attested(self, syllable: Syllable) -> bool:
        """True too where no tone is written, or the spelling isn't in the table."""
        held = self.tones.get(spelling(syllable._replace(erhua=False)))
        return syllable.tone is None or held is None or syllable.tone in held

    def narrowed(self, found: list[Syllable]) -> list[Syllable]:
        """The attested ones, or all if none is."""
        return [s for s in found if self.attested(s)] or found


NO_TONES = ToneTable()
