import zipfile

import pytest
from pyspark.sql import functions as F

from inkstone import queries
from inkstone.operators import dictionary as d
from inkstone.operators import merge as m
from inkstone.operators import metrics, script_tables
from inkstone.sources import parsers as s


def entries(spark, rows):
    out = [(h, t, [], [c], None, f, "", False, [], []) for h, t, c, f in rows]
    return spark.createDataFrame(out, d.ENTRY_DDL)


def test_merged_fixture(spark):
    merged = queries.merged_fixture(spark)
    found = {r.hans: r for r in merged.where("hant is not null").collect()}
    text = lambda w: " ".join(found[w].reading)
    assert text("银行") == "yin2 hang2" and found["银行"].hant == "銀行" and found["银行"].frequency == 5200
    assert text("大夫") == "dai4 fu5" and text("玩儿") == "wanr2" and found["头发"].hant == "頭髮"
    assert found["垃圾"].taiwan == ["le4", "se4"] and found["垃圾"].frequency == 1166
    assert found["北京"].proper and found["毛泽东"].boundaries == [1] and found["毛泽东"].pos == "nr"
    assert found["行"].alternates == ["xing2"] and found["头"].hant == "頭" and "囗囗" not in found
    composed = {r.hans: r.taiwan for r in m.compose_taiwan(merged.where("hant is not null").drop("events")).collect()}
    assert composed["垃圾桶"] == ["le4", "se4", "tong3"]
    assert {r.event for r in m.statistics(merged).collect()} >= {"erhua", "taiwan", "pair"}


def test_gates(spark):
    merged = queries.merged_fixture(spark).where("hant is not null")
    assert m.failures(merged, {"银行": "yín háng", "大夫": "dài fu5"}) == []
    assert m.failures(merged, {"银行": "yín xíng"}) == ["银行: yin2 hang2, not yin2 xing2"]
    assert m.unattested(merged, m.inventory(merged)).isEmpty()


@pytest.mark.parametrize("word,tokens,expected", [("银行", ["yin2", "hang2"], "yin2 hang2"), ("玩儿", ["wan2", "r5"], "wanr2"), ("阿Ｑ", ["a1"], None), ("一，二", ["yi2", "er4"], "yi1 er4"), ("这儿", ["zhe4", "er5"], "zhe4 er5"), ("好", ["xx"], None), ("不", ["bu2"], "bu4"), ("，", ["，"], None)])
def test_alignment(word, tokens, expected):
    found = m.syllables(m.aligned(word, tokens))
    assert (None if found is None else " ".join(d.numbers(found))) == expected


def test_parsers(spark):
    line = lambda t: s.lines_of(spark, t)
    rows = s.cedict(line("# c\n甲 甲 [jia3] /one/two/\nbad\n乙 乙 [yi3] /x/also Taiwan pr. [yi2]/\n丙 丙 [xx5] /y/\n丁 丁 [ding1] /Taiwan pr. [ding4]/")).orderBy("ord").collect()
    assert [(r.simplified, r.scope, r.taiwan) for r in rows] == [("甲", None, None), ("乙", "sense", ["yi2"]), ("丁", "entry", ["ding4"])]
    assert rows[0].definitions == ["one", "two"]
    assert [(r.word, r.frequency, r.pos) for r in s.frequencies(line("a 1 n\nb x v\na 2\n\nc 3 q z")).orderBy("word").collect()] == [("a", 2.0, ""), ("c", 3.0, "q")]
    assert [(r.word, r.readings) for r in s.phrases(line("好: hǎo # n\nab: a\n好: hào\n坏 huài\n坏:")).collect()] == [("好", ["hào"])]
    uni = s.unihan_readings(line("U+4E00\tkMandarin\tyī yí\nU+4E00\tkHanyuPinlu\tyí(3) yì(9)\nU+4E00\tkXHC1983\t0001.010:yī,yāo\nU+4E00\tkOther\tx\n#")).first()
    assert (uni.character, uni.readings, uni.taiwan) == ("一", ["yì", "yí", "yī", "yāo"], "yí")
    assert [(r.character, r.kind, r.variants) for r in s.unihan_variants(line("U+53D1\tkTraditionalVariant\tU+767C U+9AEE")).collect()] == [("发", "traditional", ["發", "髮"])]
    assert [(r.character, r.form) for r in s.opencc_default(s.opencc(line("#x\n爲\t為 爲\nbad"))).collect()] == [("爲", "為")]
    tables = s.conversion_lines(line("t\t发\t發\tfa4=髮\t\nz\ta\tb\nh\t银")).orderBy("tag").collect()
    assert [(r.tag, r.source, r.to, r.readings) for r in tables] == [("h", "银", "", {}), ("t", "发", "發", {"fa4": "髮"})]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x 1\ny 2\n")
    assert s.frequencies(s.lines(spark, str(tmp_path / "a.txt"))).count() == 2
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("Unihan_Readings.txt", "U+4E00\tkMandarin\tyī\n")
    assert s.unihan_readings(s.zip_lines(spark, str(tmp_path / "u.zip"), "Unihan_Readings.txt")).first().readings == ["yī"]
    (tmp_path / "k").write_text("银\n行\n银行")
    (tmp_path / "e").write_text("yin2\nhang2\tx\tv\tp1\txing2,heng2\n")
    rows = {r.key: r for r in d.from_stored(s.stored_dictionary(spark, str(tmp_path / "k"), str(tmp_path / "e"))).collect()}
    assert rows["行"].pos == "v" and rows["行"].proper and rows["行"].boundaries == [1] and rows["行"].alternates == ["xing2", "heng2"]
    (tmp_path / "e").write_text("yin2\nhang2\n\n")
    assert {r.key: r.reading for r in d.from_stored(s.stored_dictionary(spark, str(tmp_path / "k"), str(tmp_path / "e"))).collect()}["银"] == ["yin2"]


def test_stored_format_round_trips(spark):
    sample = d.sample_entries(spark)
    assert d.round_trip_failures(sample).isEmpty()
    lines = {r.key: r.line for r in d.stored_lines(sample).collect()}
    assert lines["银行"] == "yin2 hang2" and lines["海鸥"] == "" and lines["北京"] == "\t\tns\tp" and lines["行"] == "xing2\t\t\t\thang2,heng2"


def test_claims_tiers_and_buckets(spark):
    own = entries(spark, [("a", "A", "yi1", 5), ("b", "a", "yi1", 9), ("a", "Z", "yi1", 7), ("cd", "cd", "yi1", 3), ("ef", "ef", "yi1", 4), ("x", "x", "yi1", 0)])
    claimed = {r.key: (r.hans, r.frequency) for r in d.claim_keys(own).collect()}
    assert claimed["a"] == ("a", 7) and claimed["A"] == ("a", 5) and claimed["Z"] == ("a", 7)
    assert sorted(r.hans for r in d.tier(own, "core").collect()) == ["a", "a", "b"]
    assert sorted(r.hans for r in d.tier(own, "standard", 1).collect()) == ["a", "a", "b", "ef"]
    assert d.tier(own).count() == 6
    buckets = {r.frequency: r.bucket for r in d.frequency_buckets(own).collect()}
    assert buckets[9] == 15 and buckets[0] == 0
    assert d.frequency_buckets(spark.createDataFrame([(-5,), (0,)], "frequency bigint")).select("bucket").distinct().collect()[0].bucket == 0


def test_readings(spark):
    frame = d.dictionary_frame(d.sample_entries(spark))
    words = spark.createDataFrame([("行",), ("x",)], "word string")
    assert [(r["rank"], r.reading) for r in d.readings(words, frame).orderBy("rank").collect()] == [(0, "xing2"), (1, "hang2"), (2, "heng2")]


def test_script_tables(spark):
    rows = [("发展", "發展", ["fa1", "zhan3"]), ("发现", "發現", ["fa1", "xian4"]), ("头发", "頭髮", ["tou2", "fa4"]), ("理发", "理髮", ["li3", "fa4"]), ("出发", "出發", ["chu1", "fa1"])]
    own = spark.createDataFrame([(a, b, [], r, None, 1, "", False, [], []) for a, b, r in rows], d.ENTRY_DDL)
    tables = script_tables.collected(script_tables.build(own))
    assert tables.to_hant["发"].to == "發" and tables.to_hant["发"].by_reading == {"fa4": "髮"}
    assert tables.hant_words == {} and "发" in tables.hans_only and "髮" in tables.hant_only
    lines = {r.line for r in script_tables.written(script_tables.build(own)).collect()}
    assert "t\t发\t發\tfa4=髮" in lines and "h\t发" in lines
    a, b = spark.createDataFrame([("x", "y")], "source string, to string"), spark.createDataFrame([("x", "z")], "source string, to string")
    assert {(r.to, r.only_in) for r in script_tables.glyph_differences(a, b).collect()} == {("y", "derived"), ("z", "kept")}


def test_derived_glyphs(spark):
    forms = lambda *rows: spark.createDataFrame(list(rows), "character string, forms array<string>")
    counts = lambda words: script_tables.character_counts(spark.createDataFrame([(w,) for w in words], "w string"), "w")
    taiwan, hong_kong = forms(("爲", ["為"]), ("床", ["床"]), ("着", ["著"]), ("才", ["才"])), forms(("床", ["牀"]), ("爲", ["為"]), ("才", ["纔"]))
    found = script_tables.derived_glyphs(taiwan, hong_kong, counts(["着急"]), counts(["纔"] * 12 + ["才"]))
    assert {(r.kind, r.source, r.to) for r in found.collect()} == {("canonical", "爲", "為"), ("canonical", "牀", "床"), ("excluded", "着", "著"), ("excluded", "纔", "才"), ("hong_kong", "床", "牀"), ("hong_kong", "才", "纔"), ("hong_kong", "著", "着")}


def test_metrics(spark):
    assert metrics.case_counts("Nǐ hǎo.", "nǐhǎo") == (1, 0, 2, 2, 2, 2, 1, 1, 2, 1)
    df = spark.createDataFrame([("Nǐ hǎo", "Nǐ hǎo"), ("yín háng", "yínxíng"), (None, "")], "e string, a string")
    row = metrics.report(metrics.scored(df, "e", "a")).first()
    assert row.exact == pytest.approx(200 / 3) and row.readings == 75.0 and row.bases == 75.0 and row.tones == 100.0
    assert metrics.report(metrics.scored(df.where("false"), "e", "a")).count() == 1
    assert F is not None


def test_a_tier_is_written_and_loaded(spark, tmp_path):
    entries = d.sample_entries(spark)
    d.write_stored(entries, str(tmp_path), "core")
    lines = s.stored_tier(spark, str(tmp_path), "core")
    want = d.dictionary_frame(entries)
    columns = ["key", "reading", "taiwan", "proper", "bucket", "alternates", "cost"]
    assert sorted(map(repr, d.from_stored(lines).select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    assert s.tier_files("full") == {"keys": "full.keys", "entries": "full.entries", "frequencies": "full.freq"}
    keys = (tmp_path / "core.keys").read_text().split("\n")[:-1]
    assert keys == sorted(keys, key=lambda k: k.encode("utf-16-be"))
    assert len((tmp_path / "core.freq").read_bytes()) == (len(keys) + 1) // 2
