import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.functions import numerals as n
from inkstone.functions import orthography as o
from inkstone.functions import phonology as p
from inkstone.functions import sandhi as s

CASES = {0: "零", 2: "二", 10: "十", 15: "十五", 102: "一百零二", 115: "一百一十五", 1005: "一千零五", 2000: "两千", 2026: "两千零二十六", 12345: "一万两千三百四十五", 10015: "一万零一十五", 20000: "两万", 22222: "两万两千二百二十二", 100000001: "一亿零一", 200000000: "两亿", 1000010: "一百万零一十"}


@pytest.mark.parametrize("value,hanzi", CASES.items())
def test_cardinals(value, hanzi):
    assert n.cardinal(value) == hanzi


def test_columns_match_values(spark):
    values = [*CASES, 2**53 - 1, 9_999_999_999_999_999 // 2, 10**12 + 2, 2_0002_0002, *range(990, 1021), *range(9_990, 10_020), 2222_2222_2222_2222 % 2**53]
    for liang in ("always", "leading", "never"):
        for counts in (False, True):
            df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", n.cardinal_column(F.col("v"), liang, counts).alias("h"))
            assert {r.v: r.h for r in df.collect()} == {v: n.cardinal(v, liang, counts) for v in values}


def test_numeral_text(spark):
    texts = ["12345", "-2.50", "0.05", "2", "x", "", None, "1e5", "９", "007", "9007199254740992", "00000000000000000000012"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for options in ({}, {"style": "digits"}, {"style": "digits", "zero": "零"}, {"counts": True}):
        rows = df.select(n.numeral_column(F.col("t"), **options).alias("h")).collect()
        assert [r.h for r in rows] == [None if t is None else n.numeral(t, **options) for t in texts], options


def test_other_columns(spark):
    row = spark.range(1).select(n.percent_column(F.lit("95")).alias("a"), n.fraction_column(F.lit("1"), F.lit("4")).alias("b"), n.clock_column(F.lit(2), F.lit(5)).alias("c"), n.clock_column(F.lit(24), F.lit(0)).alias("d"), n.pinyin_column(F.lit("一千零五")).alias("e"), n.pinyin_column(F.lit("一x")).alias("f"), n.pinyin_column(F.lit("一一"), yao=True).alias("g")).first()
    assert tuple(row) == ("百分之九十五", "四分之一", "两点零五分", None, ["yī", "qiān", "líng", "wǔ"], None, ["yāo", "yāo"])


def test_numbers_in_text():
    hanzi = lambda *a: [x.hanzi for x in n.segments(*a)]
    assert hanzi("2", "", "个") == ["两"] and hanzi("2", "第", "个") == ["二"] and hanzi("2", "", "月") == ["二"]
    assert hanzi("2026", "", "年") == ["二〇二六"] and hanzi("25%", "", "") == ["百分之二十五"] and hanzi("1,234", "", "") == ["一千二百三十四"]
    assert hanzi("3:05", "", "") == ["三点零五分"] and hanzi("25:05", "", "") == [None] and hanzi("10-20", "", "") == [None]
    assert n.segments("2.5", "", "个")[0] == n.Segment("2.5", "二点五", "cardinal", (1, 1, 1))


@given(st.text(alphabet="0123456789.,:-% a", max_size=20))
def test_segments_lose_nothing(text):
    assert "".join(x.text for x in n.segments(text, "", "个")) == text


def said(text, **options):
    return [p.write(x) for x in s.apply(p.read_word(text), **options)]


def test_sandhi():
    assert said("bùshì") == ["bú", "shì"] and said("yīgè") == ["yí", "gè"] and said("yītiān") == ["yì", "tiān"] and said("dìyīgè") == ["dì", "yī", "gè"]
    assert said("shíyī") == ["shí", "yī"] and said("nǐhǎo", third=True) == ["ní", "hǎo"] and said("bùshì", yi_bu_on=False) == ["bù", "shì"]
    three = [p.parse(x) for x in ("xiǎo", "lǎo", "hǔ")]
    tones = lambda g: [x.tone for x in s.third_tone(three, g)]
    assert tones(None) == [2, 2, 3] and tones([1, 2]) == [3, 2, 3] and tones([[1, 2]]) == [3, 2, 3] and tones([5]) == [2, 2, 3]


def test_sandhi_column_matches(spark):
    import itertools

    tokens = ["yi1", "bu4", "shi4", "di4", "bai3", "ling2", "ge5"]
    words = [list(w) for w in itertools.product(tokens, repeat=3)]
    rows = spark.createDataFrame([(w,) for w in words], "w array<string>").select("w", s.yi_bu_column(F.col("w")).alias("x")).collect()
    for r in rows:
        assert r.x == [p.write(x, "numbers") for x in s.yi_bu([p.parse(t) for t in r.w])], r.w


def test_orthography(spark):
    assert "".join(o.latin_punctuation("好，吗？ 是。")) == "好, 吗? 是."
    assert "".join(o.sentence_capitals("ab. cd 3.5 e! f")) == "Ab. Cd 3.5 e! F"
    assert o.is_sentence("a.") and not o.is_sentence("3.5") and not o.is_sentence("a")
    texts = ["好，吗？ 是。", "3.5", "a.", ".5", "5.", "", "x。y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", o.latin_punctuation_column(F.col("t")).alias("l"), o.is_sentence_column(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.l == "".join(o.latin_punctuation(r.t)) and r.s == o.is_sentence(r.t)


def test_slugs():
    assert o.slug_hash("权利") == "1lpt" and o.slug_hash("权力") == "uta0"
    assert o.slug_of_words(["ab", "cd"], max_length=4) == "ab" and o.slug_of_words(["abcdef"], max_length=4) == "abcd"
    assert o.slug_of_words([], suffix="x1") == "x1" and o.slug_of_words([], fallback="none") == "none" and o.slug_of_words(["abc", "de"], max_length=8, suffix="zz") == "abc-zz"
    assert o.ascii_fold("Café!").split() == ["cafe"]
