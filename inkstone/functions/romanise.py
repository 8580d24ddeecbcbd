"""Five transcription systems: bopomofo, Wade-Giles, Yale, Gwoyeu Romatzyh and IPA, written and read.

A system spells an onset and a rime; its quirks are rules over those. Reading goes through
an inverse index: the spelling of every inventory syllable, so a spelling may stand for
several (candidates come in inventory order), narrowed by a table of attested tones where
one is given.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import cache

from . import phonology as p
from .phonology import FINALS, INVENTORY, NEUTRAL, NO_TONES, Syllable, ToneTable

_APICAL = frozenset(("zh", "ch", "sh", "r", "z", "c", "s"))
_LABIAL = frozenset("bpmf")
_nfc = lambda text: unicodedata.normalize("NFC", text)

# ---- bopomofo -------------------------------------------------------------------------
#: Fixed values.
_B_ONSET = {
    "": "", "b": "ㄅ", "p": "ㄆ", "m": "ㄇ", "f": "ㄈ", "d": "ㄉ", "t": "ㄊ", "n": "ㄋ", "l": "ㄌ", "g": "ㄍ", "k": "ㄎ",
    "h": "ㄏ", "j": "ㄐ", "q": "ㄑ", "x": "ㄒ", "zh": "ㄓ", "ch": "ㄔ", "sh": "ㄕ", "r": "ㄖ", "z": "ㄗ", "c": "ㄘ", "s": "ㄙ",
}
#: Fixed values.
_B_RIME = {
    "a": "ㄚ", "o": "ㄛ", "e": "ㄜ", "ê": "ㄝ", "er": "ㄦ", "ai": "ㄞ", "ei": "ㄟ", "ao": "ㄠ", "ou": "ㄡ", "an": "ㄢ",
    "en": "ㄣ", "ang": "ㄤ", "eng": "ㄥ", "ong": "ㄨㄥ", "i": "ㄧ", "ia": "ㄧㄚ", "ie": "ㄧㄝ", "iao": "ㄧㄠ", "iou": "ㄧㄡ",
    "ian": "ㄧㄢ", "in": "ㄧㄣ", "iang": "ㄧㄤ", "ing": "ㄧㄥ", "iong": "ㄩㄥ", "u": "ㄨ", "ua": "ㄨㄚ", "uo": "ㄨㄛ", "uai": "ㄨㄞ",
    "uei": "ㄨㄟ", "uan": "ㄨㄢ", "uen": "ㄨㄣ", "uang": "ㄨㄤ", "ueng": "ㄨㄥ", "ü": "ㄩ", "üe": "ㄩㄝ", "üan": "ㄩㄢ", "ün": "ㄩㄣ",
    "io": "ㄧㄛ", "m": "ㄇ", "n": "ㄋ", "ng": "ㄫ",
}
_B_TONE = {1: "ˉ", 2: "ˊ", 3: "ˇ", 4: "ˋ", NEUTRAL: "˙"}
_B_READ = {**{v: k for k, v in _B_TONE.items()}, "¯": 1, "´": 2, "`": 4, "·": NEUTRAL}
_B_ER = "ㄦ"


def bopomofo(s: Syllable, first_tone: bool = False) -> str:
    """The neutral dot stands first; the first tone is written only on request; the suffix follows the mark."""
    body = _B_ONSET[s.initial] + ("" if s.final == "i" and s.initial in _APICAL else _B_RIME[s.final])
    tail = _B_ER if s.erhua else ""
    sign = "" if s.tone is None or s.tone == 1 and not first_tone else _B_TONE[s.tone]
    return sign + body + tail if s.tone == NEUTRAL else body + sign + tail


@cache
def _bopomofo_index() -> dict[str, tuple[str, str, bool]]:
    """Written symbols to sounds, for every onset and rime; spellings with an onset go first."""
    out: dict[str, tuple[str, str, bool]] = {}
    for er in (False, True):
        for onset in (*filter(None, _B_ONSET), ""):
            for rime in FINALS:
                if rime in ("er",) and onset or rime == "ueng" and onset or rime == "ong" and not onset:
                    continue
                body = bopomofo(Syllable(onset, rime, None, er))
                out.setdefault(body, (onset, rime, er))
    return out


def read_bopomofo(text: str) -> Syllable | None:
    """Unmarked is the first tone."""
    body, tone = _nfc(text.strip()), 1
    if body[:1] in _B_READ:
        tone, body = _B_READ[body[0]], body[1:]
        if body[-1:] in _B_READ and body:
            return None
    elif body[-1:] in _B_READ:
        tone, body = _B_READ[body[-1]], body[:-1]
    elif body.endswith(_B_ER) and body[-2:-1] in _B_READ:
        tone, body = _B_READ[body[-2]], body[:-2] + _B_ER
    found = _bopomofo_index().get(body) if body else None
    return None if found is None else Syllable(found[0], found[1], tone, found[2])


def is_bopomofo(text: str) -> bool:
    symbols = {c for v in (*_B_ONSET.values(), *_B_RIME.values()) for c in v} | set(_B_READ)
    return bool(text.strip()) and all(c in symbols for c in text.strip())


# ---- Wade-Giles -----------------------------------------------------------------------
#: Fixed values.
_W_ONSET = {
    "": "", "b": "p", "p": "p'", "m": "m", "f": "f", "d": "t", "t": "t'", "n": "n", "l": "l", "g": "k", "k": "k'",
    "h": "h", "j": "ch", "q": "ch'", "x": "hs", "zh": "ch", "ch": "ch'", "sh": "sh", "r": "j", "z": "ts", "c": "ts'",
    "s": "s",
}
#: Fixed values.
_W_RIME = {
    "a": "a", "o": "o", "e": "ê", "ê": "eh", "er": "êrh", "ai": "ai", "ei": "ei", "ao": "ao", "ou": "ou", "an": "an",
    "en": "ên", "ang": "ang", "eng": "êng", "ong": "ung", "i": "i", "ia": "ia", "ie": "ieh", "iao": "iao",
    "iou": "iu", "ian": "ien", "in": "in", "iang": "iang", "ing": "ing", "iong": "iung", "u": "u", "ua": "ua",
    "uo": "uo", "uai": "uai", "uei": "ui", "uan": "uan", "uen": "un", "uang": "uang", "ueng": "uêng", "ü": "ü",
    "üe": "üeh", "üan": "üan", "ün": "ün", "io": "io", "m": "m", "n": "n", "ng": "ng",
}
#: Fixed values.
_W_ALONE = {
    "a": "a", "o": "o", "e": "ê", "ê": "eh", "er": "êrh", "ai": "ai", "ei": "ei", "ao": "ao", "ou": "ou", "an": "an",
    "en": "ên", "ang": "ang", "eng": "êng", "ong": "ung", "i": "i", "ia": "ya", "ie": "yeh", "iao": "yao",
    "iou": "yu", "ian": "yen", "in": "yin", "iang": "yang", "ing": "ying", "iong": "yung", "u": "wu", "ua": "wa",
    "uo": "wo", "uai": "wai", "uei": "wei", "uan": "wan", "uen": "wên", "uang": "wang", "ueng": "wêng", "ü": "yü",
    "üe": "yüeh", "üan": "yüan", "ün": "yün", "io": "yo", "m": "m", "n": "n", "ng": "ng",
}
_W_VARIANTS = {"yi": "yi", "o": "e", "ch'uo": "chuo"}  # read, not written: spelling to pinyin
_W_ER, _W_DROPPED = "-'rh", {"'": "", "ê": "e", "ŭ": "u", "ü": "u"}
_W_LOOSE_ER = "-rh"


def wade_giles_spelling(s: Syllable) -> str:
    onset, rime = _W_ONSET[s.initial], _W_RIME[s.final]
    if not s.initial:
        rime = _W_ALONE[s.final]
    elif s.final == "i" and s.initial in ("z", "c", "s"):
        onset, rime = {"z": "tz", "c": "tz'", "s": "ss"}[s.initial], "ŭ"
    elif s.final == "i" and s.initial in _APICAL:
        rime = "ih"
    elif s.final == "e" and s.initial in ("g", "k", "h") or s.final == "uo" and s.initial in ("d", "t", "n", "l", "z", "c", "s", "zh", "ch", "r"):
        rime = "o"
    elif s.final == "uei" and s.initial in ("g", "k"):
        rime = "uei"
    return onset + rime + (_W_ER if s.erhua else "")


def wade_giles(s: Syllable, tones: str = "superscript") -> str:
    spelt = wade_giles_spelling(s._replace(erhua=False))
    digit = "" if s.tone is None or tones == "none" else str(s.tone) if tones == "numbers" else p._RAISED[s.tone]
    return spelt + digit + (_W_ER if s.erhua else "")


def _dropped(text: str) -> str:
    return "".join(_W_DROPPED.get(c, c) for c in text)


@cache
def _wade_index() -> tuple[dict, dict]:
    exact, loose = defaultdict(list), defaultdict(list)
    spelt = [(wade_giles_spelling(p.parse(x)), p.parse(x)) for x in INVENTORY] + [(w, p.parse(x)) for w, x in _W_VARIANTS.items()]
    for w, s in spelt:
        for index, key in ((exact, w), (loose, _dropped(w))):
            if all(s.sound() != other.sound() for _, other in index[key]):
                index[key].append((w, s))
    return dict(exact), dict(loose)


def _covers(whole: str, written: str) -> bool:
    """Whether the written form is the whole one with some marks left out."""
    at = 0
    for c in whole:
        if written[at : at + 1] == c:
            at += 1
        elif c in _W_DROPPED and written.startswith(_W_DROPPED[c], at):
            at += len(_W_DROPPED[c])
        else:
            return False
    return at == len(written)


def _wade_text(text: str) -> str:
    return re.sub("[ʻʼ‘’`´ʹ]", "'", _nfc(text.strip()).lower())


def _digit_tone(text: str) -> tuple[str, int | None]:
    plain = p.lower_digits(text)
    return (plain[:-1], int(plain[-1]) or NEUTRAL) if plain[-1:] in tuple("012345") else (text, None)


def read_wade_giles(text: str, loosely: bool = False, tones: ToneTable = NO_TONES) -> list[Syllable]:
    """Candidates of a spelling; loosely, those it becomes with marks left out follow the exact ones."""
    body = _wade_text(text)
    exact, loose = _wade_index()

    def found(index: dict, key, suffixes: tuple[str, ...]) -> list[Syllable]:
        suffix = next((x for x in suffixes if body.endswith(x)), "")
        spelt, tone = _digit_tone(body[: len(body) - len(suffix)])
        return [s._replace(tone=tone, erhua=bool(suffix)) for w, s in index.get(key(spelt), ()) if _covers(w, spelt)]

    first = tones.narrowed(found(exact, str, (_W_ER,)))
    if not loosely:
        return first
    held = {(s.sound(), s.erhua) for s in first}
    return tones.narrowed(first + [s for s in found(loose, _dropped, (_W_ER, _W_LOOSE_ER)) if (s.sound(), s.erhua) not in held])


def split_wade_giles(text: str) -> list[str] | None:
    """Syllables of a word written solid or with hyphens, the longest first; hyphens divide only where nothing reads across them."""
    run = _wade_text(text)
    if not run:
        return None
    if read_wade_giles(run, loosely=True):
        return [run]
    exact, loose = _wade_index()
    most = max(map(len, exact)) + 1 + len(_W_ER)
    nasal = {w for w in loose if not re.search("[aeiouêŭü]", w)}
    memo: dict[str, list[str] | None] = {"": []}

    def cut(rest: str) -> list[str] | None:
        if rest not in memo:
            memo[rest] = None
            for n in range(min(most, len(rest)), 0, -1):
                if rest[:n] not in nasal and read_wade_giles(rest[:n], loosely=True) and (tail := cut(rest[n:])) is not None:
                    memo[rest] = [rest[:n], *tail]
                    break
        return memo[rest]

    if (whole := cut(run)) is not None:
        return whole
    parts = [x for x in run.split("-") if x]
    pieces = [cut(x) for x in parts]
    return None if len(parts) < 2 or None in pieces else [x for piece in pieces for x in piece]


def read_wade_giles_word(text: str) -> list[Syllable] | None:
    parts = split_wade_giles(text)
    return None if parts is None else [read_wade_giles(x, loosely=True)[0] for x in parts]


# ---- Yale -----------------------------------------------------------------------------
#: Fixed values.
_Y_ONSET = {
    "": "", "b": "b", "p": "p", "m": "m", "f": "f", "d": "d", "t": "t", "n": "n", "l": "l", "g": "g", "k": "k",
    "h": "h", "j": "j", "q": "ch", "x": "sy", "zh": "j", "ch": "ch", "sh": "sh", "r": "r", "z": "dz", "c": "ts",
    "s": "s",
}
#: Fixed values.
_Y_RIME = {
    "a": "a", "o": "o", "e": "e", "ê": "e", "er": "er", "ai": "ai", "ei": "ei", "ao": "au", "ou": "ou", "an": "an",
    "en": "en", "ang": "ang", "eng": "eng", "ong": "ung", "i": "i", "ia": "ya", "ie": "ye", "iao": "yau",
    "iou": "you", "ian": "yan", "in": "in", "iang": "yang", "ing": "ing", "iong": "yung", "u": "u", "ua": "wa",
    "uo": "wo", "uai": "wai", "uei": "wei", "uan": "wan", "uen": "wun", "uang": "wang", "ueng": "weng", "ü": "yu",
    "üe": "ywe", "üan": "ywan", "ün": "yun", "io": "yo", "m": "m", "n": "n", "ng": "ng",
}
_Y_ALONE = {"i": "yi", "in": "yin", "ing": "ying", "u": "wu", "uen": "wen"}


def yale_spelling(s: Syllable) -> str:
    onset, rime = _Y_ONSET[s.initial], _Y_RIME[s.final]
    if not s.initial:
        rime = _Y_ALONE.get(s.final, rime)
    elif s.final == "i" and s.initial in _APICAL:
        rime = "z" if s.initial in ("z", "c", "s") else "r"
    elif s.final == "o" and s.initial in _LABIAL:
        rime = "wo"
    if onset.endswith(rime[0]):  # one letter where they meet: sya, dz
        rime = rime[1:]
    return onset + rime + ("r" if s.erhua else "")


def yale(s: Syllable, tones: str = "marks") -> str:
    if s.tone is None or tones == "none":
        return yale_spelling(s)
    if tones == "numbers":
        return yale_spelling(s) + str(s.tone)
    plain = yale_spelling(s._replace(erhua=False))
    marked = p.mark(plain, s.tone)
    if marked == plain and s.tone != NEUTRAL:  # no vowel to carry it
        marked = _nfc(plain + p._MARKS[s.tone - 1])
    return marked + ("r" if s.erhua else "")


# ---- IPA ------------------------------------------------------------------------------
#: Fixed values.
_I_ONSET = {
    "": "", "b": "p", "p": "pʰ", "m": "m", "f": "f", "d": "t", "t": "tʰ", "n": "n", "l": "l", "g": "k", "k": "kʰ",
    "h": "x", "j": "tɕ", "q": "tɕʰ", "x": "ɕ", "zh": "ʈʂ", "ch": "ʈʂʰ", "sh": "ʂ", "r": "ʐ", "z": "ts", "c": "tsʰ",
    "s": "s",
}
#: Fixed values.
_I_RIME = {
    "a": "a", "o": "ɔ", "e": "ɤ", "ê": "ɛ", "er": "aɚ", "ai": "ai", "ei": "ei", "ao": "au", "ou": "ou", "an": "an",
    "en": "ən", "ang": "aŋ", "eng": "əŋ", "ong": "ʊŋ", "i": "i", "ia": "ia", "ie": "ie", "iao": "iau", "iou": "iou",
    "ian": "iɛn", "in": "in", "iang": "iaŋ", "ing": "iŋ", "iong": "iʊŋ", "u": "u", "ua": "ua", "uo": "uo",
    "uai": "uai", "uei": "uei", "uan": "uan", "uen": "uən", "uang": "uaŋ", "ueng": "uəŋ", "ü": "y", "üe": "ye",
    "üan": "yɛn", "ün": "yn", "io": "iɔ", "m": "m̩", "n": "n̩", "ng": "ŋ̍",
}
_I_LETTERS = {1: "˥", 2: "˧˥", 3: "˨˩˦", 4: "˥˩", NEUTRAL: ""}
_I_NUMBERS = {1: "55", 2: "35", 3: "214", 4: "51", NEUTRAL: ""}


def ipa_symbols(s: Syllable) -> str:
    rime = "ɨ" if s.final == "i" and s.initial in _APICAL else "uo" if s.final == "o" and s.initial in _LABIAL else _I_RIME[s.final]
    return _I_ONSET[s.initial] + rime + ("ɚ" if s.erhua else "")


def ipa(s: Syllable, tones: str = "letters") -> str:
    if s.tone is None or tones == "none":
        return ipa_symbols(s)
    return ipa_symbols(s) + (_I_NUMBERS if tones == "numbers" else _I_LETTERS)[s.tone]


# ---- Gwoyeu Romatzyh: the tone is in the spelling -------------------------------------
#: Fixed values.
_G_ONSET = {
    "": "", "b": "b", "p": "p", "m": "m", "f": "f", "d": "d", "t": "t", "n": "n", "l": "l", "g": "g", "k": "k",
    "h": "h", "j": "j", "q": "ch", "x": "sh", "zh": "j", "ch": "ch", "sh": "sh", "r": "r", "z": "tz", "c": "ts",
    "s": "s",
}
#: Fixed values.
_G_RIME = {
    "a": "a", "o": "o", "e": "e", "ê": "è", "er": "el", "ai": "ai", "ei": "ei", "ao": "au", "ou": "ou", "an": "an",
    "en": "en", "ang": "ang", "eng": "eng", "ong": "ong", "i": "i", "ia": "ia", "ie": "ie", "iao": "iau",
    "iou": "iou", "ian": "ian", "in": "in", "iang": "iang", "ing": "ing", "iong": "iong", "u": "u", "ua": "ua",
    "uo": "uo", "uai": "uai", "uei": "uei", "uan": "uan", "uen": "uen", "uang": "uang", "ueng": "ueng", "ü": "iu",
    "üe": "iue", "üan": "iuan", "ün": "iun", "io": "io", "m": "m", "n": "n", "ng": "ng",
}
#: Fixed values.
_G_ER_RIME = {
    "a": "a", "o": "o", "e": "e", "ê": "è", "er": "el", "ai": "a", "ei": "e", "ao": "au", "ou": "ou", "an": "a",
    "en": "e", "ang": "ang", "eng": "eng", "ong": "ong", "i": "ie", "ia": "ia", "ie": "ie", "iao": "iau",
    "iou": "iou", "ian": "ia", "in": "ie", "iang": "iang", "ing": "ieng", "iong": "iong", "u": "u", "ua": "ua",
    "uo": "uo", "uai": "ua", "uei": "ue", "uan": "ua", "uen": "ue", "uang": "uang", "ueng": "ueng", "ü": "iue",
    "üe": "iue", "üan": "iua", "ün": "iue", "io": "io", "m": "m", "n": "n", "ng": "ng",
}
_G_APOSTROPHE = {"e": 3, "ie": 2, "üe": 2}  # before the suffix, up to this tone
_VOWEL = re.compile("[aeiouyè]+")


def _g_two(form: str, onset: str) -> str:
    if onset in ("l", "m", "n", "r"):
        return form
    for letter, glide in (("i", "y"), ("u", "w")):
        at = form.find(letter)
        if at >= 0 and not _VOWEL.match(form[at - 1 : at] if at else ""):
            return form[:at] + glide + (form[at + 1 :] or letter)
    span = _VOWEL.search(form)
    end = span.end() if span else len(form)
    return form[:end] + "r" + form[end:]


def _g_three(form: str) -> str:
    places = sorted((form.find(x), y) for x, y in (("i", "e"), ("u", "o")) if x in form)
    if places:
        at, other = places[0]
        around = [form[at - 1] if at else "", form[at + 1 : at + 2]]
        if any(_VOWEL.fullmatch(c) for c in around) and other not in around:
            return form[:at] + other + form[at + 1 :]
    span = _VOWEL.search(form)
    start, end = span.span() if span else (len(form) - 1, len(form))
    rime = form[start:end]
    at = start + next((rime.index(v) for v in "aoe" if v in rime), len(rime) - 1)
    return form[: at + 1] + form[at:]


def _g_four(form: str) -> str:
    before = form[-2:-1]
    if form[-1] == "i" and _VOWEL.fullmatch(before):
        return form[:-1] + "y"
    if form[-1] == "u" and _VOWEL.fullmatch(before) and before != "i":
        return form[:-1] + "w"
    if form.endswith("ng"):
        return form[:-2] + "nq"
    return form + (form[-1] if form[-1] in "nl" else "h")


def _g_alone(form: str, basic: str) -> str:
    """Third and fourth tones without an onset take y or w, in the medial's place where one stands."""
    if basic[0] not in "iu":
        return form
    replaces = form[0] == basic[0] and bool(_VOWEL.fullmatch(form[1:2])) and form[1] != basic[0]
    return ("y" if basic[0] == "i" else "w") + (form[1:] if replaces else form)


def _g_toned(basic: str, onset: str, tone: int) -> str:
    if tone == 1:
        return basic[0] + "h" + basic[1:] if onset in ("l", "m", "n", "r") else basic
    if tone == 2:
        return _g_two(basic, onset)
    form = _g_three(basic) if tone == 3 else _g_four(basic)
    return form if onset else _g_alone(form, basic)


def _g_plain(s: Syllable) -> str:
    apical = s.final == "i" and s.initial in _APICAL
    if s.erhua:
        return _G_ONSET[s.initial] + ("e" if apical else _G_ER_RIME[s.final])
    return _G_ONSET[s.initial] + ("y" if apical else _G_RIME[s.final])


def _g_spelt(s: Syllable, tone: int) -> str:
    basic = _g_plain(s)
    if not s.erhua:
        return _g_toned(basic, s.initial, tone)
    if tone < 4:
        return _g_toned(basic, s.initial, tone) + ("'" if tone <= _G_APOSTROPHE.get(s.final, 0) else "") + "l"
    own = s.final == "e" or re.search("(?:[aeiou]u|ng)$", basic)
    form = _g_four(basic) + "l" if own else basic + "ll"
    return form if s.initial else _g_alone(form, basic)


def gwoyeu(s: Syllable) -> str:
    """A neutral syllable is a dot and its original tone's form; a missing tone is written as the first."""
    if s.tone != NEUTRAL:
        return _g_spelt(s, s.tone or 1)
    if s.original_tone is not None and s.original_tone != NEUTRAL:
        return "." + _g_spelt(s, s.original_tone)
    return "." + _g_plain(s) + ("'" * (s.final in _G_APOSTROPHE) + "l" if s.erhua else "")


@cache
def _gwoyeu_index() -> dict[str, list[Syllable]]:
    out = defaultdict(list)
    for x in INVENTORY:
        for tone in (1, 2, 3, 4):
            for er in (False, True):
                s = p.parse(x)._replace(tone=tone, erhua=er)
                out[_g_spelt(s, tone)].append(s)
    return dict(out)


def read_gwoyeu(text: str, tones: ToneTable = NO_TONES) -> list[Syllable]:
    body = _nfc(text.strip()).lower()
    found = _gwoyeu_index().get(body.removeprefix("."), [])
    if body.startswith("."):
        found = [s._replace(tone=NEUTRAL, original_tone=s.tone) for s in found]
    return tones.narrowed(list(found))


# ---- readers over spelling indexes, and words -----------------------------------------
@cache
def _index(system: str) -> dict[str, list[Syllable]]:
    spell, out = {"yale": yale_spelling, "ipa": ipa_symbols}[system], defaultdict(list)
    for x in INVENTORY:
        out[spell(p.parse(x))].append(p.parse(x))
    return dict(out)


def _candidates(system: str, spelt: str, tone: int | None, suffix: str, tones: ToneTable) -> list[Syllable]:
    index = _index(system)
    found = [s._replace(tone=tone) for s in index.get(spelt, ())]
    if spelt != suffix and spelt.endswith(suffix):
        found += [s._replace(tone=tone, erhua=True) for s in index.get(spelt[: -len(suffix)], ())]
    return tones.narrowed(found)


def read_yale(text: str, tones: ToneTable = NO_TONES) -> list[Syllable]:
    body, tone = _digit_tone(_nfc(text.strip()).lower())
    return _candidates("yale", p.strip_marks(body), p.tone_of_marks(text) if tone is None else tone, "r", tones)


def read_ipa(text: str, tones: ToneTable = NO_TONES) -> list[Syllable]:
    found = re.fullmatch("(.*?)([˥˦˧˨˩]+|214|55|35|51|[0-5])", _nfc(text.strip()), re.DOTALL)
    written = {v: k for d in (_I_LETTERS, _I_NUMBERS) for k, v in d.items() if v}
    if found is None:
        return _candidates("ipa", _nfc(text.strip()), None, "ɚ", tones)
    tone = written.get(found[2]) or (int(found[2]) or NEUTRAL if len(found[2]) == 1 and found[2] in "012345" else None)
    return _candidates("ipa", _nfc(text.strip()) if tone is None else found[1], tone, "ɚ", tones)


#: name: writer of a syllable, what joins a word.
SYSTEMS = {
    "pinyin": (p.write, ""),
    "bopomofo": (bopomofo, " "),
    "wade_giles": (wade_giles, "-"),
    "yale": (yale, ""),
    "gwoyeu": (gwoyeu, ""),
    "ipa": (ipa, ""),
}


def word(system: str, syllables, **options) -> str:
    """A word in one of SYSTEMS."""
    write, joint = SYSTEMS[system]
    if system == "pinyin":
        return "".join(p.apostrophes([write(s, **options) for s in syllables]))
    return joint.join(write(s, **options) for s in syllables)
