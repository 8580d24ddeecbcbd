import itertools

import pytest
from pyspark.sql import functions as F

from inkstone.functions.glyphs import runs, runs_column
from inkstone.operators import dictionary as d
from inkstone.operators import lattice as relational
from inkstone.operators import script_tables
from inkstone.plans import convert as c
from inkstone.plans import decoder as k
from inkstone.plans import grouping as g
from inkstone.plans import sample
from inkstone.plans.udf import Texts


@pytest.fixture(scope="module")
def dictionary():
    return sample.dictionary(idioms=["千军万马"])


def word(text, pos="", proper=False, syllables=None):
    reading = tuple(sample.read(syllables) if syllables else sample.read("_".join(["a1"] * len(text))))
    return g.Word(text, reading, proper, pos)


TEXTS = ["银行长大", "北京市银行", "玩儿不是", "海鸥", "我去西安大行长", "垃圾", "儿", "行长行长", "天天"]


def test_relational_lattice_is_the_kernels(spark):
    frame = d.dictionary_frame(d.sample_entries(spark))
    own = d.collected(frame)
    assert own.entries == sample.dictionary().entries
    edges = relational.edges(spark.createDataFrame([(t, t) for t in TEXTS], "run_id string, text string"), frame).cache()
    rows = {t: [] for t in TEXTS}
    for r in edges.orderBy("run_id", "ord").collect():
        rows[r.run_id].append((r.start, r.end, tuple(r.reading), r.cost, r.reading_cost))
    cuts, held, paths = {t: [] for t in TEXTS}, {t: [] for t in TEXTS}, {}
    for r in relational.cut_points(edges).orderBy("run_id", "at").collect():
        cuts[r.run_id].append(r["at"])
    for r in relational.locks(edges).orderBy("run_id", "at").collect():
        held[r.run_id].append(r.locked)
    for cost, charge in (("cost", 0), ("reading_cost", 16)):
        paths[charge] = {r.run_id: r.path for r in relational.shortest_paths(edges, cost).collect()}
    greedy = {t: [] for t in TEXTS}
    for r in relational.greedy_words(spark.createDataFrame([(t, t) for t in TEXTS], "run_id string, text string"), frame).orderBy("run_id", "start").collect():
        greedy[r.run_id].append(r.word)
    claims = {}
    for r in relational.claim_costs(edges).collect():
        claims.setdefault(r.run_id, {})[(r.start, r.end, r.reading)] = r.cost
    for t in TEXTS:
        lattice = k.lattice(own, t)
        assert rows[t] == [(e.start, e.end, tuple(d.numbers(e.reading)), e.cost, e.reading_cost) for at in lattice for e in at]
        assert cuts[t] == k.cuts(lattice)
        assert held[t] == [u is not None for u in k.locks(lattice)]
        for charge in (0, 16):
            assert paths[charge][t] == [e.start for e in k.path(lattice, 0, len(t), charge)]
        assert greedy[t] == [w.text for w in k.greedy(own, t)]
        expected, _ = k._claims(lattice, 0, len(t))
        assert claims[t] == {(u.start, u.end, " ".join(d.numbers(u.reading))): pytest.approx(cost) for u, cost in expected.values()}


def test_conversions(dictionary):
    read = lambda t, **o: c.to_pinyin(dictionary, t, c.Options(**o))
    assert read("银行长大") == "yínháng zhǎngdà" and read("北京市") == "Běijīng Shì" and read("不是") == "bú shì" and read("海鸥") == "hǎi'ōu"
    assert read("海鸥", apostrophe="standard") == "hǎiōu" and read("西安", notation="numbers") == "Xi1an1" and read("玩儿") == "wánr"
    assert read("好。好！") == "Hǎo. Hǎo!" and read("垃圾", locale="zh-TW") == "lèsè" and read("一天2个") == "yì tiān liǎng gè"
    assert read("好3.5好") == "hǎo sān diǎn wǔ hǎo" and read("iPhone 15", numbers="keep") == "iPhone 15" and read("") == "" and read("好x") == "hǎox"
    assert c.to_pinyin(dictionary, "行长大", method="greedy") == "hángzhǎng dà"


def test_confidence_and_html(dictionary):
    found = [x for x in c.pieces(dictionary, "行长大", method="scored") if x.syllable]
    assert [x.confidence.uncertain() for x in found] == [True, False, False]
    html = c.to_html(found[:1])
    assert html == '<span class="py-syllable py-tone-2 py-uncertain" lang="zh-Latn-CN-pinyin" data-alternatives="háng héng">xíng</span>'
    assert c.to_html([c.Piece("<&>")]) == "&lt;&amp;&gt;"


def test_systems_and_slugs(dictionary):
    assert c.to_system(c.pieces(dictionary, "北京市银行"), "wade_giles") == "Pei³-ching¹ Shih⁴ yin²-hang²"
    slugs = {"银行": "yin2hang2", "北京市银行": "bei3jing1-shi4-yin2hang2", "玩儿": "wanr2", "不是": "bu2-shi4", "iPhone 15 银行": "iphone-15-yin2hang2"}
    for text, slug in slugs.items():
        assert c.to_slug(dictionary, text) == slug
    assert c.to_slug(dictionary, "垃圾", c.SlugOptions(locale="zh-TW")) == "le4se4"
    assert c.to_slug(dictionary, "西安", c.SlugOptions(tones="none")) == "xi-an"


def test_scripts(spark, dictionary):
    tables = script_tables.collected(script_tables.build(d.sample_entries(spark)))
    assert c.to_script(dictionary, tables, "玩儿银行", "zh-Hant")[0] == "玩兒銀行"
    assert c.to_script(dictionary, tables, "銀行x", "zh-Hans")[0] == "银行x"
    text, choices = c.to_script(dictionary, tables, "儿", "zh-Hant")
    assert choices[0].evidence in ("locked", "word", "reading", "default") and text in ("儿", "兒")
    assert c.to_script(dictionary, tables, "台", "zh-Hant-HK", "Hant")[0] == "台"
    assert c.detect_script("银银", tables) == "Hans" and c.detect_script("好", tables) is None


def test_edge_rules():
    entry = lambda w, r, pos="", *others: k.Entry(w, sample.read(r), None, pos, alternates=tuple(sample.read(x) for x in others))
    own = k.Dictionary([entry("我", "wǒ", "r"), entry("得", "dé", "ud", "děi", "de"), entry("走", "zǒu", "v"), entry("教", "jiào", "", "jiāo"), entry("他", "tā", "r"), entry("三", "sān", "m"), entry("个", "gè", "q"), entry("个人", "gè_rén", "n"), entry("人", "rén", "n"), entry("玩", "wán", "v"), entry("儿", "ér"), entry("玩儿", "wánr"), entry("第", "dì")])
    read = lambda t: "".join(x.text for x in c.pieces(own, t, c.Options(yi_bu=False, capitals="none")))
    assert read("我得走") == "wǒ děi zǒu"
    assert read("我教他") == "wǒ jiāo tā"
    edges = k.ruled(k.lattice(own, "三个人"), own, "三个人")
    assert "个人" not in [e.text for e in edges[1]]
    assert "个人" in [e.text for e in k.ruled(k.lattice(own, "第三个人"), own, "第三个人")[2]]
    assert [e.text for e in k.ruled(k.lattice(own, "玩儿"), own, "玩儿")[1]] == []


def test_relational_rules_are_the_kernels(spark):
    rows = [("我", "wo3", "r"), ("得", "de2", "ud", "dei3", "de5"), ("走", "zou3", "v"), ("教", "jiao4", "", "jiao1"), ("他", "ta1", "r"), ("三", "san1", "m"), ("个", "ge4", "q"), ("个人", "ge4 ren2", "n"), ("人", "ren2", "n"), ("玩", "wan2", "v"), ("儿", "er2", ""), ("玩儿", "wanr2", ""), ("第", "di4", ""), ("信教", "xin4 jiao4", ""), ("信", "xin4", "v"), ("了", "le5", "ul")]
    frame = spark.createDataFrame([(w, r.split(), None, pos, False, [], 0, list(others)) for w, r, pos, *others in rows], d.DICTIONARY_DDL)
    frame = frame.withColumn("cost", d.cost(F.col("bucket")))
    own = d.collected(frame)
    texts = ["我得走", "我教他", "三个人", "第三个人", "玩儿", "信教了", "信教他", "得走", "他教", "我得", "三三个人", "儿", "x得走"]
    runs_ = spark.createDataFrame([(t, t) for t in texts], "run_id string, text string")
    edges = relational.edges(runs_, frame)
    found = {t: [] for t in texts}
    for r in relational.ruled(edges, runs_, frame).orderBy("run_id", "ord").collect():
        found[r.run_id].append((r.start, r.end, tuple(r.reading)))
    for t in texts:
        expected = k.ruled(k.lattice(own, t), own, t)
        assert found[t] == [(e.start, e.end, tuple(d.numbers(e.reading))) for at in expected for e in at], t


def test_grouping(dictionary):
    own = lambda *words: [(w.text, w.joint) for w in g.grouped(list(words), dictionary)]
    assert own(word("看", "v"), word("了", "ul")) == [("看了", " ")]
    assert own(word("我", "r"), word("们", "k")) == [("我们", " ")]
    assert own(word("北京市", "ns", True)) == [("北京", " "), ("市", " ")]
    assert own(word("一个")) == [("一", " "), ("个", " ")]
    assert own(word("中国", "ns"), word("人")) == [("中国人", " ")]
    assert own(word("高高兴兴")) == [("高高", " "), ("兴兴", "-")]
    assert own(word("考虑"), word("考虑")) == [("考虑", " "), ("考虑", "-")]
    assert own(word("千军万马")) == [("千军", " "), ("万马", "-")]
    assert g.grouped([word("老"), word("王", "nr", True)], dictionary)[0].proper


def test_runs(spark):
    texts = ["abc银行2个", "", "好", "〇々x", "a\U00020000b", "，好，"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", runs_column(F.col("t")).alias("r"))
    for r in df.collect():
        assert [(x.text, x.is_han) for x in r.r] == runs(r.t)


def test_udfs_match_kernel(spark, dictionary):
    texts = ["".join(x) for x in itertools.product(["银行", "北京市", "x"], ["2个", "好。", ""])]
    tables = script_tables.collected(script_tables.build(d.sample_entries(spark)))
    own = Texts(spark, dictionary, tables)
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    rows = df.select("t", own.pinyin(F.col("t")).alias("p"), own.html(F.col("t")).alias("h"), own.slug(F.col("t")).alias("s"), own.system(F.col("t"), "bopomofo").alias("b"), own.script(F.col("t"), "zh-Hant").alias("z"), own.pieces(F.col("t")).alias("x"), own.script_choices(F.col("t"), "zh-Hant").alias("y")).collect()
    for r in rows:
        if r.t is None:
            assert set(r) == {None}
            continue
        assert r.p == c.to_pinyin(dictionary, r.t) and r.s == c.to_slug(dictionary, r.t)
        assert r.h == c.to_html(c.pieces(dictionary, r.t, method="scored")) and "".join(x.text for x in r.x) == r.p
        assert r.z == c.to_script(dictionary, tables, r.t, "zh-Hant")[0] and len(r.y) == sum(len(x) for x, han in runs(r.t) if han)


def test_streams(spark, dictionary, tmp_path):
    from inkstone.streaming.convert import syllable_counts, with_pinyin

    spark.createDataFrame([("银行", "2024-01-01 00:00:10"), ("北京", "2024-01-01 00:00:40")], "text string, ts string").selectExpr("text", "cast(ts as timestamp) ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text string, ts timestamp").parquet(f"{tmp_path}/in")
    own = Texts(spark, dictionary)
    for name, df, mode in (("said", with_pinyin(stream, own), "append"), ("counts", syllable_counts(stream, own, "ts"), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        assert query.awaitTermination(120)
    assert {r.pinyin for r in spark.table("said").collect()} == {"yínháng", "Běijīng"}
    assert {(r.syllable, r.n) for r in spark.table("counts").collect()} == {("yín", 1), ("háng", 1), ("běi", 1), ("jīng", 1)}
