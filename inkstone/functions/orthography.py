"""Written pinyin: capitals, punctuation, word grouping, HTML, and slugs."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

ENDINGS = frozenset(".!?。！？")
#: Chinese punctuation and its Latin form.
LATIN = dict(zip("。，、；：？！", ".,,;:?!", strict=True))


def _ends(text: str, k: int) -> bool:
    return text[k] in ENDINGS and not (text[k] == "." and text[k - 1 : k].isdigit() and text[k - 1 : k].isascii() and text[k + 1 : k + 2].isdigit() and text[k + 1 : k + 2].isascii())


def is_sentence(text: str) -> bool:
    return any(_ends(text, k) for k in range(len(text)))


def is_sentence_column(text: Column) -> Column:
    """Has an ending that is no decimal point."""
    return text.rlike(r"[!?。！？]|(?<![0-9])\.|\.(?![0-9])")


def over_parts(parts: list[str], rewrite) -> list[str]:
    """A rewrite of the joined text, one string a character, dealt back to the parts."""
    new = iter(rewrite("".join(parts)))
    return ["".join(next(new) for _ in part) for part in parts]


def sentence_capitals(text: str) -> list[str]:
    out, pending = [], True
    for k, c in enumerate(text):
        if pending and c.lower() != c.upper():
            pending = False
            out.append(c.upper())
        else:
            out.append(c)
            pending = pending or _ends(text, k)
    return out


def latin_punctuation(text: str) -> list[str]:
    return [c if c not in LATIN else LATIN[c] + (" " if text[k + 1 : k + 2] not in ("", " ") else "") for k, c in enumerate(text)]


def latin_punctuation_column(text: Column) -> Column:
    """Chinese marks in Latin, with a space after where none follows and the text goes on."""
    spaced = F.regexp_replace(text, "([。，、；：？！])(?=[^ ])", "$1 ")
    return F.translate(spaced, "".join(LATIN), "".join(LATIN.values()))


def capital(text: str) -> str:
    return text[:1].upper() + text[1:]


def escape_html(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(raw, safe)
    return text


def escape_html_column(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


# ---- slugs ----------------------------------------------------------------------------
def ascii_fold(text: str) -> str:
    """Lower-case Latin without marks; what isn't a-z or 0-9 becomes a blank."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", plain)


def slug_hash(text: str, length: int = 4) -> str:
    """The last 1 to 7 base-36 digits of a 32-bit hash of the text (FNV-1a over UTF-8, then an avalanche)."""
    h = 0x811C9DC5
    for b in unicodedata.normalize("NFC", text).encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    h ^= h >> 16
    out = ""
    while h or len(out) < 7:
        h, d = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out[-max(1, min(7, length)) :]


def slug_of_words(words: list[str], separator: str = "-", max_length: int | None = None, suffix: str = "", fallback: str = "") -> str:
    """Words joined and cut at a word to the length; a single longer word is cut hard; the suffix always stays."""
    room = None if max_length is None else max(0, max_length - (len(suffix) + len(separator) if suffix else 0))
    out = ""
    for word in words:
        grown = out + separator + word if out else word
        if room is not None and len(grown) > room:
            out = out or word[:room]
            break
        out = grown
    if suffix:
        return out + separator + suffix if out else suffix
    return out or fallback


def slug_ascii_column(text: Column, separator: str = "-") -> Column:
    """Slugs of plain ASCII text."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", separator), F.lit(separator))
