"""Numbers in Chinese: hanzi as Columns and as Python values, their readings, and numbers within text."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phonology import Syllable, parse, write

DIGITS = "零一二三四五六七八九"
LARGEST = 2**53 - 1  # whole numbers beyond it are not exact doubles, so they have no reading
GROUP_UNITS = ("", "万", "亿", "万亿")
#: What each numeral character is read as.
READINGS = dict(zip("零〇一二两兩三四五六七八九十百千万萬亿億点點负負分之", "líng líng yī èr liǎng liǎng sān sì wǔ liù qī bā jiǔ shí bǎi qiān wàn wàn yì yì diǎn diǎn fù fù fēn zhī".split(), strict=True))
QUANTITY = frozenset("零一二三四五六七八九〇两兩十百千万亿萬億")


# ---- Columns --------------------------------------------------------------------------
def bind(value: Column, function) -> Column:
    """function(value) with the value computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _digit(d: Column) -> Column:
    return F.substring(F.lit(DIGITS), d.cast("int") + 1, F.lit(1))


def _group(g: Column, leading: Column, liang: str) -> Column:
    """A group of four digits; nothing for 0."""
    th, hu, te, on = (F.floor(g / k) % 10 for k in (1000, 100, 10, 1))
    two = {"always": F.lit(True), "leading": leading, "never": F.lit(False)}[liang]
    return F.concat(
        F.when(th > 0, F.concat(F.when((th == 2) & two, "两").otherwise(_digit(th)), F.lit("千"))).otherwise(""),
        F.when(hu > 0, F.concat(_digit(hu), F.lit("百"))).otherwise(""),
        F.when((te > 0) & (hu == 0) & (th > 0), "零").otherwise(""),
        F.when(te > 0, F.concat(F.when((te == 1) & (g < 20) & leading, "").otherwise(_digit(te)), F.lit("十"))).otherwise(""),
        F.when((on > 0) & (te == 0) & (g > 99), "零").otherwise(""),
        F.when(on > 0, _digit(on)).otherwise(""),
    )


def cardinal_column(value: Column, liang: str = "always", counts: bool = False) -> Column:
    """A whole number's hanzi; null outside 0 to 2**53 - 1."""
    units = F.array(*(F.lit(u) for u in GROUP_UNITS))
    places = F.array(*(F.lit(10 ** (4 * k)).cast("bigint") for k in range(5)))

    def whole(n: Column) -> Column:
        def add(acc: Column, k: Column) -> Column:
            return bind(F.call_function('div', n, F.element_at(places, k + 1)) % 10000, lambda g: F.struct(F.when(g == 0, acc["text"]).otherwise(F.concat(body(g, k), gap(acc), acc["text"])).alias("text"), g.alias("below")))

        def body(g: Column, k: Column) -> Column:
            leading = n < F.coalesce(F.get(places, k + 1), F.lit(1 << 62))
            lone = (k > 0) & (g == 2) & {"always": F.lit(True), "leading": leading, "never": F.lit(False)}[liang]
            return F.concat(F.when(lone, "两").otherwise(_group(g, leading, liang)), F.get(units, k))

        def gap(acc: Column) -> Column:
            return F.when((acc["text"] != "") & (acc["below"] < 1000), "零").otherwise("")

        start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("below"))
        written = F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, add, lambda acc: acc["text"])
        said = F.when(n == 0, "零").when((n == 2) & F.lit(counts and liang != "never"), "两").otherwise(written)
        return F.when(n.between(0, LARGEST), said)

    return bind(value.cast("bigint"), whole)


def digits_column(text: Column, zero: str = "〇") -> Column:
    """Digits one by one."""
    return F.translate(text.cast("string"), "0123456789", zero + DIGITS[1:])


def numeral_column(text: Column, style: str = "cardinal", zero: str = "〇", liang: str = "always", counts: bool = False) -> Column:
    """A written number (sign, digits, optional fraction); null for anything else. Doubles should be cast to decimal first."""

    def said(found: Column) -> Column:
        if style == "digits":
            body = digits_column(found["whole"], zero)
        else:
            n = F.when(F.length(F.ltrim(found["whole"], F.lit("0"))) <= 16, found["whole"].try_cast("bigint"))
            body = cardinal_column(n, liang)
            if counts:
                body = F.when(found["fraction"] == "", cardinal_column(n, liang, True)).otherwise(body)
        point = F.when(found["fraction"] == "", "").otherwise(F.concat(F.lit("点"), digits_column(found["fraction"], "零")))
        return F.when(found["whole"] != "", F.concat(F.when(found["sign"] == "-", "负").otherwise(""), body, point))

    part = lambda s, k: F.regexp_extract(s, r"^(-?)([0-9]+)(?:\.([0-9]+))?$", k)
    return bind(text.cast("string"), lambda s: bind(F.struct(part(s, 1).alias("sign"), part(s, 2).alias("whole"), part(s, 3).alias("fraction")), said))


def percent_column(text: Column, **options) -> Column:
    return F.concat(F.lit("百分之"), numeral_column(text, **options))


def fraction_column(top: Column, bottom: Column, **options) -> Column:
    return F.concat(numeral_column(bottom, **options), F.lit("分之"), numeral_column(top, **options))


def clock_column(hours: Column, minutes: Column) -> Column:
    """A time of day: 两点, 三点零五分; null outside 0:00 to 23:59."""
    hour = F.when(hours == 2, "两").otherwise(cardinal_column(hours))
    minute = F.when(minutes == 0, "").otherwise(F.concat(F.when(minutes < 10, "零").otherwise(""), cardinal_column(minutes), F.lit("分")))
    return F.when(hours.between(0, 23) & minutes.between(0, 59), F.concat(hour, F.lit("点"), minute))


def pinyin_column(hanzi: Column, notation: str = "marks", yao: bool = False) -> Column:
    """Syllables of numeral hanzi as an array; null if a character is no numeral."""
    spelt = {c: write(parse(r), notation) for c, r in READINGS.items()}
    if yao:
        spelt["一"] = write(parse("yāo"), notation)
    table = F.create_map(*(F.lit(x) for pair in spelt.items() for x in pair))
    read = F.transform(F.split(hanzi, ""), lambda c: F.try_element_at(table, c))
    return bind(read, lambda r: F.when(F.forall(r, lambda x: x.isNotNull()), r))


# ---- Python values, for the decoder ---------------------------------------------------
def cardinal(value: int, liang: str = "always", counts: bool = False) -> str:
    if value == 0:
        return "零"
    if value == 2 and counts and liang != "never":
        return "两"
    groups, out = [], ""
    while value:
        value, low = divmod(value, 10000)
        groups.append(low)
    for k, g in enumerate(groups):
        if not g:
            continue
        top = k == len(groups) - 1
        two = liang == "always" or liang == "leading" and top
        body = re.sub("零+$", "", re.sub("零+", "零", re.sub("零[千百十]", "零", "".join(DIGITS[int(d)] + u for d, u in zip(f"{g:04d}", ("千", "百", "十", ""), strict=True))))).lstrip("零")
        if top and g < 20:
            body = body.removeprefix("一") if g >= 10 else body
        if two and body.startswith("二千") or two and k and body == "二":
            body = "两" + body[1:]
        out = body + GROUP_UNITS[k] + ("零" if out and groups[k - 1] < 1000 else "") + out
    return out


def numeral(text: str, style: str = "cardinal", zero: str = "〇", liang: str = "always", counts: bool = False) -> str | None:
    found = re.fullmatch(r"(-?)([0-9]+)(?:\.([0-9]+))?", text)
    if found is None or style != "digits" and int(found[2]) > LARGEST:
        return None
    spell = lambda digits, nought: "".join(nought if d == "0" else DIGITS[int(d)] for d in digits)
    whole = spell(found[2], zero) if style == "digits" else cardinal(int(found[2]), liang, counts and found[3] is None)
    return ("负" if found[1] else "") + whole + ("点" + spell(found[3], "零") if found[3] else "")


def read_hanzi(hanzi: str) -> tuple[Syllable, ...] | None:
    out = [READINGS.get(c) for c in hanzi]
    return None if None in out else tuple(parse(r) for r in out)


class Segment(NamedTuple):
    """A piece of text between Han runs: a number with its hanzi, or text that isn't one."""

    text: str
    hanzi: str | None = None
    style: str | None = None
    words: tuple[int, ...] | None = None  # sizes of the words it is written as, where there are several


#: Characters after which a number is a label, not a count; signs beside an identifier.
LABELLED, SMALL_UNITS, IDENTIFIER = frozenset("月日号號楼樓路班期"), frozenset("十百"), frozenset(":：-－—–/／")
_FIGURES = r"[0-9][0-9,]*+(?:\.[0-9]+)?+"
_SIGNS = "".join(map(re.escape, sorted(IDENTIFIER)))
#: What digits in a text may be: a time of day (and figures that hang on it), part of an identifier, or a number.
_TOKEN = re.compile(
    rf"(?P<hour>[01]?[0-9]|2[0-3])[:：](?P<minute>[0-5][0-9])(?![0-9])(?P<rest>(?:,[0-9,]*)?(?:\.[0-9]+)?)"
    rf"|(?<=[{_SIGNS}]){_FIGURES}|{_FIGURES}(?=[{_SIGNS}])"
    rf"|(?P<number>{_FIGURES})(?P<percent>[%％]?)"
)


class Place(NamedTuple):
    """A number where it stands: its digits, and whether it is a share, a year or a count."""

    digits: str
    share: bool
    year: bool
    count: bool


#: Which places take which style and wording, the first that holds.
_WORDINGS = (
    (lambda p: p.share, lambda p: ("cardinal", numeral(p.digits), "百分之")),
    (lambda p: p.year, lambda p: ("digits", numeral(p.digits, "digits"), "")),
    (lambda p: True, lambda p: ("cardinal", numeral(p.digits, counts=p.count), "")),
)


def _clock_words(found: re.Match) -> list[str]:
    hour, minute = int(found["hour"]), int(found["minute"])
    minutes = [("零" if minute < 10 else "") + cardinal(minute), "分"] if minute else []
    return ["两" if hour == 2 else cardinal(hour), "点", *minutes]


def _placed(found: re.Match, before: str, after: str) -> Place:
    text, touches = found.string, found.end() == len(found.string)
    leads = text[found.start() - 1] if found.start() else before
    counted = touches and after != "" and after not in LABELLED | SMALL_UNITS and leads != "第"
    return Place(found["number"].replace(",", ""), found["percent"] != "", after == "年" and len(found["number"]) == 4, counted)


def _worded(found: re.Match, before: str, after: str) -> Segment | None:
    """The number that a token is, or None."""
    if found["hour"]:
        words = _clock_words(found)
        return Segment(found[0][: len(found[0]) - len(found["rest"])], "".join(words), "cardinal", tuple(map(len, words)))
    if not found["number"]:
        return None
    place = _placed(found, before, after)
    style, hanzi, lead = next(wording(place) for holds, wording in _WORDINGS if holds(place))
    if hanzi is None:
        return None
    whole, point, tail = (lead + hanzi).partition("点")
    words = (len(whole), *(1 for _ in point + tail)) if point and style != "digits" else None
    return Segment(found[0], lead + hanzi, style, words)


def segments(text: str, before: str, after: str) -> list[Segment]:
    """The numbers of a non-Han run; before and after are the Han characters beside it, or empty."""
    numbers = [(m.start(), s) for m in _TOKEN.finditer(text) if (s := _worded(m, before, after))]
    starts = [at for at, _ in numbers] + [len(text)]
    ends = [0] + [at + len(s.text) for at, s in numbers]
    between = [Segment(text[a:b]) for a, b in zip(ends, starts, strict=True)]
    every = [x for pair in zip(between, [s for _, s in numbers], strict=False) for x in pair] + between[-1:]
    return [x for x in every if x.text]


def said(segment: Segment, follows: Syllable | None, on: bool = True, third: bool = False) -> tuple[Syllable, ...]:
    """A number's syllables; sandhi reaches the count before its point, and sees what follows."""
    from .sandhi import apply

    reading = read_hanzi(segment.hanzi)
    if segment.style == "digits":
        return reading
    n = segment.hanzi.find("点")
    n = len(reading) if n < 0 else n
    changed = apply([*reading[:n], *([follows] if follows else [])], on, third)
    return (*changed[:n], *reading[n:])


