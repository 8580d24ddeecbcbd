"""Han characters: runs, variant glyphs, script detection, and conversion tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each pair is a variant and its canonical (Taiwan) form.
CANONICAL_PAIRS = "僞偽衹只啓啟喫吃粧妝嫺嫻嬀媯峯峰捝挩敍敘枴柺棁梲樑梁枱檯涚涗潙溈潨潀爲為牀床癡痴皁皂竈灶糉粽糭粽綫線緼縕繮韁纔才羣群脣唇蒀蒕蔘參蔿蒍藴蘊衆眾衞衛裏裡覈核説說輼轀醖醞鉢缽鈎鉤鋭銳鍼針閲閱鮎鯰鰛鰮麪麵齶顎"
#: Each pair is a canonical form and Hong Kong's.
HONG_KONG_PAIRS = "兌兑叄叁啟啓囪囱媼媪嫻嫺峰峯么幺悅悦慍愠戶户挩捝搵揾敓敚敘敍柺枴梲棁榲榅梁樑簷檐檯枱氳氲汙污洩泄涗涚溫温溼濕熅煴床牀痺痹著着睪睾稅税縕緼韁繮群羣脫脱膃腽臥卧臺台菸煙蒕蒀參蔘蔥葱蘊藴蛻蜕衛衞裡裏說説轀輼醞醖鉤鈎銳鋭閱閲鯰鮎鰮鰛麵麪顎齶"
CANONICAL = dict(zip(CANONICAL_PAIRS[::2], CANONICAL_PAIRS[1::2], strict=True))
HONG_KONG = dict(zip(HONG_KONG_PAIRS[::2], HONG_KONG_PAIRS[1::2], strict=True))
KEPT_SOUND = {"著": ("zh", "u")}  # with this sound it keeps its form in Hong Kong
HAN = r"\p{IsHan}"

_to_canonical = str.maketrans(CANONICAL)


_variants = frozenset(CANONICAL)


def canonical(text: str) -> str:
    return text if _variants.isdisjoint(text) else text.translate(_to_canonical)


def canonical_column(text: Column) -> Column:
    return F.translate(text, "".join(CANONICAL), "".join(CANONICAL.values()))


def hong_kong_column(text: Column) -> Column:
    """Without readings: every character takes its Hong Kong form."""
    return F.translate(text, "".join(HONG_KONG), "".join(HONG_KONG.values()))


def regional(text: str, region: str, sounds=()) -> str:
    """The canonical text in TW (as it is) or HK; sounds: (initial, final) of each character, where known."""
    if region == "TW":
        return text
    return "".join(c if k < len(sounds) and sounds[k] is not None and KEPT_SOUND.get(c) == tuple(sounds[k]) else HONG_KONG.get(c, c) for k, c in enumerate(text))


def runs_column(text: Column) -> Column:
    """Maximal Han and non-Han runs, in order: array<struct<text, is_han>>."""
    parts = F.regexp_extract_all(text, F.lit(f"({HAN}+|[^{HAN}]+)"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(x.alias("text"), x.rlike(f"^{HAN}").alias("is_han")))


# Han script by code point, for Python's re, which has no script classes.
_RANGES = [(0x2E80, 0x2E99), (0x2E9B, 0x2EF3), (0x2F00, 0x2FD5), (0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFA6D), (0xFA70, 0xFAD9), (0x16FE2, 0x16FE3), (0x16FF0, 0x16FF1), (0x20000, 0x2A6DF), (0x2A700, 0x2EBE0), (0x2F800, 0x2FA1D), (0x30000, 0x323AF)]


def is_han(c: str) -> bool:
    point = ord(c)
    return any(a <= point <= b for a, b in _RANGES)


def runs(text: str) -> list[tuple[str, bool]]:
    out: list[tuple[str, bool]] = []
    start = 0
    for k in range(1, len(text) + 1):
        if k == len(text) or is_han(text[k]) != is_han(text[start]):
            out.append((text[start:k], is_han(text[start])))
            start = k
    return out


def script_column(text: Column, hans_only: str, hant_only: str) -> Column:
    """Hans or Hant, whichever has more characters of its own; null on a tie."""

    def count(of: str) -> Column:
        return F.char_length(text) - F.char_length(F.translate(text, of, "")) if of else F.lit(0)

    hans, hant = count(hans_only), count("".join(c for c in hant_only if c not in hans_only))
    return F.when(hans > hant, "Hans").when(hant > hans, "Hant")
