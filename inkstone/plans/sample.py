"""A small dictionary for tests and queries, entered by hand: word, reading, and what else is known of it."""

from __future__ import annotations

import math

from ..functions.phonology import NEUTRAL, parse
from .decoder import BUCKETS, Dictionary, Entry

#: Word, other script's form (- if the same), reading, Taiwan reading, frequency, tag, proper noun, alternates.
ROWS = """
银 - yín
行 - xíng . 0 . . háng,héng
长 - zhǎng . 0 . . cháng
大 - dà
一 - yī
不 - bù
是 - shì
好 - hǎo
个 - gè
天 - tiān
玩 - wán
儿 - ér
北 - běi
京 - jīng
垃 - lā
圾 - jī
西 - xī
安 - ān
海 - hǎi
鸥 - ōu
市 - shì
银行 銀行 yín_háng . 5200
行长 行長 háng_zhǎng . 380
长大 - zhǎng_dà . 1300
北京 - běi_jīng . 30000 ns p
玩儿 玩兒 wánr . 260
西安 - xī_ān . 2400 ns p
海鸥 - hǎi_ōu . 210
北京市 - běi_jīng_shì . 1700 ns p
垃圾 - lā_jī lè_sè 1250
"""


def read(text: str):
    """A stored reading: every syllable has a tone, the neutral one where none is written."""
    return tuple(s.toned(s.tone or NEUTRAL) for s in map(parse, text.split("_")))


def rows() -> list[dict]:
    out = []
    for line in ROWS.split("\n"):
        if line:
            word, hant, cn, tw, frequency, pos, proper, alternates = (line.split() + ["."] * 7)[:8]
            out.append({"hans": word, "hant": word if hant == "-" else hant, "cn": cn, "tw": None if tw == "." else tw, "frequency": 0 if frequency == "." else int(frequency), "pos": pos.strip("."), "proper": proper == "p", "alternates": [] if alternates == "." else alternates.split(",")})
    return out


def bucket(frequency: int, most: int) -> int:
    return 0 if most <= 0 else min(BUCKETS - 1, math.floor(math.log1p(max(0, frequency)) * ((BUCKETS - 1) / math.log1p(most)) + 0.5))


def dictionary(idioms=()) -> Dictionary:
    """Headwords, then forms of the other script that are no headwords."""
    own = rows()
    most = max(r["frequency"] for r in own)
    entry = lambda key, r: Entry(key, read(r["cn"]), read(r["tw"]) if r["tw"] else None, r["pos"], r["proper"], (), bucket(r["frequency"], most), tuple(read(a) for a in r["alternates"]))
    found = {r["hans"]: entry(r["hans"], r) for r in own}
    for r in own:
        found.setdefault(r["hant"], entry(r["hant"], r))
    return Dictionary(found.values(), idioms)
