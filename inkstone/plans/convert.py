"""Whole texts: pinyin, pieces with confidence, HTML, transcriptions, slugs and script conversion."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

from ..functions import glyphs, numerals, orthography, romanise, sandhi
from ..functions import phonology as p
from ..functions.phonology import Syllable
from .decoder import READING_CHARGE, Dictionary, Scored, Unit, decode, division, greedy
from .grouping import Word, grouped


@dataclass(frozen=True)
class Options:
    locale: str = "zh-CN"
    notation: str = "marks"
    apostrophe: str = "always"
    capitals: str = "auto"
    punctuation: str = "latin"
    grouping: bool = True
    numbers: str = "read"
    yi_bu: bool = True
    third_tone: bool = False


class Confidence(NamedTuple):
    locked: bool
    alternatives: tuple[tuple[Unit, float], ...]

    def uncertain(self) -> bool:
        return bool(self.alternatives) and self.alternatives[0][1] < READING_CHARGE


class Piece(NamedTuple):
    text: str
    syllable: Syllable | None = None
    confidence: Confidence | None = None


def _words(dictionary: Dictionary, run: str, before: str, options: Options, method: str) -> list[tuple[Word, list[Confidence]]]:
    if method == "greedy":
        words, sure = greedy(dictionary, run), []
    else:
        decoded = decode(dictionary, run, before, method == "scored")
        words = [w for w, _ in decoded]
        sure = [Confidence(s.locked, s.alternatives) for _, own in decoded for s in own for _ in s.unit.reading] if method == "scored" else []
    if options.grouping:
        words = grouped(words, dictionary)
    out, at = [], 0
    for w in words:
        out.append((w, sure[at : at + len(w.reading)]))
        at += len(w.reading)
    return out


def _localised(dictionary: Dictionary, word: Word, locale: str) -> tuple[Syllable, ...]:
    entry = dictionary.get(word.text) if locale == "zh-TW" else None
    return entry.taiwan if entry and entry.taiwan and entry.reading == word.reading else word.reading


def _spelt(syllables: Iterable[Syllable], options: Options) -> list[str]:
    style = "never" if options.notation in ("numbers", "superscript") else options.apostrophe
    return p.apostrophes([p.write(s, options.notation) for s in syllables], style)


def _han_pieces(dictionary: Dictionary, words: list[tuple[Word, list[Confidence]]], options: Options) -> list[Piece]:
    readings = [_localised(dictionary, w, options.locale) for w, _ in words]
    sizes = [division(dictionary, w.text, r) or len(r) for (w, _), r in zip(words, readings, strict=True)] if options.third_tone else None
    said = sandhi.apply([s for r in readings for s in r], options.yi_bu, options.third_tone, sizes)
    out: list[Piece] = []
    at = 0
    for k, ((w, sure), r) in enumerate(zip(words, readings, strict=True)):
        if k:
            out.append(Piece(w.joint))
        own = said[at : at + len(r)]
        at += len(r)
        if not own:
            out.append(Piece(w.text))
            continue
        spelt = _spelt(own, options)
        if w.proper and options.capitals != "none":
            spelt[0] = orthography.capital(spelt[0])
        out += [Piece(t, s, c) for t, s, c in zip(spelt, own, sure if len(sure) == len(own) else [None] * len(own), strict=True)]
    return out


def _wordlike(c: str) -> bool:
    return c.isalnum() or c != "" and c.isnumeric()


def _number_pieces(segment: numerals.Segment, follows: Syllable | None, options: Options) -> list[Piece]:
    said = numerals.said(segment, follows, options.yi_bu, options.third_tone)
    sizes = (1,) * len(said) if segment.style == "digits" else segment.words or (len(said),)
    out: list[Piece] = []
    at = 0
    for size in sizes:
        if at:
            out.append(Piece(" "))
        own = said[at : at + size]
        spelt = [p.write(s, options.notation) for s in own] if segment.style == "digits" else _spelt(own, options)
        out += [Piece(t, s) for t, s in zip(spelt, own, strict=True)]
        at += size
    return out


def _other_pieces(text: str, segments: list[numerals.Segment], after_han: bool, before_han: bool, follows: Syllable | None, options: Options) -> list[Piece]:
    if all(s.hanzi is None for s in segments):
        return [Piece(text)]
    out: list[Piece] = []
    last = "a" if after_han else ""
    for s in segments:
        if _wordlike(last[-1:]) and _wordlike(s.text[:1]):
            out.append(Piece(" "))
        out += [Piece(s.text)] if s.hanzi is None else _number_pieces(s, follows, options)
        last = out[-1].text
    if before_han and _wordlike(last[-1:]):
        out.append(Piece(" "))
    return out


def pieces(dictionary: Dictionary, text: str, options: Options = Options(), method: str = "lattice") -> list[Piece]:  # noqa: B008
    """method: lattice, scored (with confidence) or greedy."""
    parts = glyphs.runs(text)
    first = lambda k: parts[k][0][0] if 0 <= k < len(parts) and parts[k][1] else ""
    last = lambda k: parts[k][0][-1] if 0 <= k < len(parts) and parts[k][1] else ""
    numbers = [[] if han or options.numbers == "keep" else numerals.segments(t, last(k - 1), first(k + 1)) for k, (t, han) in enumerate(parts)]
    context = [(numbers[k - 1][-1].hanzi or "") if k and numbers[k - 1] else "" for k in range(len(parts))]
    words = [_words(dictionary, t, context[k], options, method) if han else [] for k, (t, han) in enumerate(parts)]
    out: list[Piece] = []
    for k, (t, han) in enumerate(parts):
        if han:
            out += _han_pieces(dictionary, words[k], options)
        else:
            ahead = words[k + 1][0][0].reading if k + 1 < len(parts) and words[k + 1] else ()
            out += _other_pieces(t, numbers[k], last(k - 1) != "", first(k + 1) != "", ahead[0] if ahead else None, options)
    for on, rewrite in ((options.capitals == "auto" and orthography.is_sentence(text), orthography.sentence_capitals), (options.punctuation == "latin", orthography.latin_punctuation)):
        if on:
            # a rewrite may lengthen a mark by a blank, so it gives a string for each character
            out = [x._replace(text=t) for x, t in zip(out, orthography.over_parts([x.text for x in out], rewrite), strict=True)]
    return out


def to_pinyin(dictionary: Dictionary, text: str, options: Options = Options(), method: str = "lattice") -> str:  # noqa: B008
    return "".join(x.text for x in pieces(dictionary, text, options, method))


def to_html(found: list[Piece], options: Options = Options(), tone_classes: bool = True, mark_uncertain: bool = True, lang: bool = True) -> str:  # noqa: B008
    out = []
    for x in found:
        safe = orthography.escape_html(x.text)
        if x.syllable is None:
            out.append(safe)
            continue
        classes = ["py-syllable"] + ([f"py-tone-{x.syllable.tone}"] if tone_classes and x.syllable.tone else [])
        others: list[str] = []
        if mark_uncertain and x.confidence and x.confidence.uncertain():
            others = list(dict.fromkeys("".join(p.write(s, options.notation) for s in u.reading) for u, cost in x.confidence.alternatives if cost < READING_CHARGE))
        if others:
            classes.append("py-uncertain")
        region = options.locale[-2:]
        attributes = [f'class="{" ".join(classes)}"'] + ([f'lang="zh-Latn-{region}-pinyin"'] if lang else []) + ([f'data-alternatives="{orthography.escape_html(" ".join(others))}"'] if others else [])
        out.append(f"<span {' '.join(attributes)}>{safe}</span>")
    return "".join(out)


def to_system(found: list[Piece], system: str, capitals: bool = True, **options) -> str:
    """Neighbouring syllables are a word of the system; a capital comes along."""
    out, word, big = [], [], False
    for x in [*found, Piece("")]:
        if x.syllable is not None:
            if not word:
                letter = re.search(r"[^\W\d_]", x.text)
                big = bool(letter) and letter[0] != letter[0].lower()
            word.append(x.syllable)
            continue
        if word:
            spelt = romanise.word(system, word, **options)
            out.append(re.sub(r"[^\W\d_]", lambda m: m[0].upper(), spelt, count=1) if big and capitals else spelt)
            word = []
        out.append(x.text)
    return "".join(out)


@dataclass(frozen=True)
class SlugOptions:
    tones: str = "numbers"
    separator: str = "-"
    syllables: str = "join"
    umlaut: str = "v"
    numbers: str = "keep"
    hash: bool | int = False
    max_length: int | None = None
    fallback: str = ""
    locale: str = "zh-CN"
    yi_bu: bool = True
    third_tone: bool = False


def to_slug(dictionary: Dictionary, text: str, options: SlugOptions = SlugOptions()) -> str:  # noqa: B008
    own = Options(options.locale, options.tones, "always" if options.tones == "none" else "never", "none", "keep", True, options.numbers, options.yi_bu, options.third_tone)
    words, open_ = [], False
    for x in pieces(dictionary, text, own):
        spelt = x.text
        if x.syllable is not None:
            breaks = spelt.startswith("'") or options.syllables == "separate"
            spelt = spelt.lstrip("'").lower().replace("ü", options.umlaut).replace("ê", "e")
            if open_ and not breaks:
                words[-1] += spelt
            else:
                words.append(spelt)
            open_ = True
            continue
        words += orthography.ascii_fold(spelt).split()
        open_ = False
    suffix = orthography.slug_hash(text, 4 if options.hash is True else options.hash) if options.hash else ""
    return orthography.slug_of_words(words, options.separator, options.max_length, suffix, options.fallback)


# ---- scripts --------------------------------------------------------------------------
class Conversion(NamedTuple):
    to: str
    by_reading: dict[str, str] = {}  # noqa: RUF012
    also: tuple[str, ...] = ()

    def forms(self) -> list[str]:
        return list(dict.fromkeys([self.to, *self.by_reading.values(), *self.also]))

    def ambiguous(self) -> bool:
        return bool(self.by_reading or self.also)


@dataclass
class ScriptTables:
    to_hant: dict[str, Conversion] = field(default_factory=dict)
    to_hans: dict[str, Conversion] = field(default_factory=dict)
    hant_words: dict[str, str] = field(default_factory=dict)
    hans_words: dict[str, str] = field(default_factory=dict)
    hans_only: frozenset[str] = frozenset()
    hant_only: frozenset[str] = frozenset()


class Choice(NamedTuple):
    source: str
    to: str
    evidence: str  # locked, word, reading or default
    alternatives: tuple[str, ...] = ()


def reading_key(s: Syllable | None) -> str:
    return "" if s is None else p.write(s._replace(erhua=False), "numbers")


def detect_script(text: str, tables: ScriptTables) -> str | None:
    hans = sum(c in tables.hans_only for c in text)
    hant = sum(c in tables.hant_only and c not in tables.hans_only for c in text)
    return None if hans == hant else "Hans" if hans > hant else "Hant"


def _choices(word: str, reading, table: dict[str, Conversion], words: dict[str, str]) -> list[Choice]:
    form = words.get(word)
    form = form if form is not None and len(form) == len(word) else None
    out = []
    for k, c in enumerate(word):
        found = table.get(c)
        at = found.by_reading.get(reading_key(reading[k] if reading else None)) if found else None
        to = form[k] if form else c if found is None else at or found.to
        evidence = "locked" if found is None or not found.ambiguous() else "word" if form else "reading" if at else "default"
        out.append(Choice(c, to, evidence, tuple(f for f in (found.forms() if found else []) if f not in (c, to))))
    return out


def to_script(dictionary: Dictionary, tables: ScriptTables, text: str, target: str = "zh-Hans", source: str | None = None) -> tuple[str, list[Choice]]:
    """target: zh-Hans, zh-Hant, zh-Hant-TW or zh-Hant-HK; source: Hans or Hant, found from the text by default."""
    script, region = ("Hans", "TW") if target == "zh-Hans" else ("Hant", "HK" if target == "zh-Hant-HK" else "TW")
    table, words = (tables.to_hans, tables.hans_words) if script == "Hans" else (tables.to_hant, tables.hant_words)
    same = (source or detect_script(text, tables)) == script
    out, choices = [], []
    for run, han in glyphs.runs(text):
        if not han:
            out.append(run)
            continue
        for w, _ in decode(dictionary, run):
            word = glyphs.canonical(w.text)
            reading = w.reading if len(w.reading) == len(word) else None
            own = [Choice(c, c, "locked") for c in word] if same else _choices(word, reading, table, words)
            if region == "HK":
                sounds = [s.sound() for s in reading] if reading else [None] * len(word)
                own = [c._replace(to=glyphs.regional(c.to, region, [s]), evidence="default" if c.to in glyphs.KEPT_SOUND and s is None else c.evidence) for c, s in zip(own, sounds, strict=True)]
            choices += own
            out += [c.to for c in own]
    return "".join(out), choices


__all__ = ["Choice", "Confidence", "Conversion", "Options", "Piece", "ScriptTables", "Scored", "SlugOptions", "detect_script", "pieces", "to_html", "to_pinyin", "to_script", "to_slug", "to_system"]
