"""The engine's own queries over the driver's tables.

The tables hold no Chinese, so numbers, times and keys of theirs choose what is read: a
number is written in hanzi, a key picks syllables or words of the sample dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import source_queries
from .functions import columns, glyphs, numerals, orthography, sandhi
from .functions.phonology import INVENTORY
from .operators import dictionary as dictionaries
from .operators import lattice, merge, metrics, script_tables
from .plans import sample
from .plans.convert import Options
from .plans.udf import Texts
from .sources import parsers

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}
WORDS = [r["hans"] for r in sample.rows()]
SANDHI_TOKENS = ["yi1", "bu4", "shi4", "ge4", "tian1", "hao3"]
GLYPHS = glyphs.CANONICAL_PAIRS[::2] + "天大人"


def _query(function: Query) -> Query:
    _found[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return _found | source_queries.queries()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(items, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in items)), (F.pmod(index, F.lit(len(items))) + 1).cast("int"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, text): three words of the sample dictionary for each order."""
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(*(_pick(WORDS, F.floor(k / d)) for d in (1, 7, 30))).alias("text"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts, named by themselves: what has to be decoded once."""
    return _texts(spark, sf_dir).select(F.col("text").alias("run_id"), "text").distinct()


def _dictionary(spark: SparkSession) -> DataFrame:
    return F.broadcast(dictionaries.dictionary_frame(dictionaries.sample_entries(spark)))


def _operators(spark: SparkSession, with_scripts: bool = False) -> Texts:
    """The script tables are built only where they are used."""
    tables = script_tables.collected(script_tables.build(dictionaries.sample_entries(spark))) if with_scripts else None
    return Texts(spark, sample.dictionary(), tables)


# ---- numerals -------------------------------------------------------------------------
@_query
def numeral_cardinal(spark, sf_dir):
    n = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", numerals.cardinal_column(n).alias("hanzi"), numerals.cardinal_column(n * 1009).alias("larger"))


@_query
def numeral_digits(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", numerals.numeral_column(F.col("o_orderkey"), "digits").alias("hanzi"))


@_query
def numeral_liang_modes(spark, sf_dir):
    n = F.col("p_partkey") * 22 + 2
    return _table(spark, sf_dir, "part").select("p_partkey", *(numerals.cardinal_column(n, liang=mode).alias(name) for mode, name in (("always", "always"), ("leading", "in_front"), ("never", "never"))))


@_query
def numeral_percent(spark, sf_dir):
    hundredths = F.round(F.abs("l_discount") * 100).cast("int")
    return _table(spark, sf_dir, "lineitem").select(numerals.percent_column(hundredths.cast("string")).alias("hanzi")).groupBy("hanzi").agg(F.count("*").alias("n"))


@_query
def numeral_fraction(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select(numerals.fraction_column(F.col("l_linenumber"), F.col("l_quantity").cast("int")).alias("hanzi")).groupBy("hanzi").agg(F.count("*").alias("n"))


@_query
def numeral_decimal(spark, sf_dir):
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    return _table(spark, sf_dir, "part").select("p_partkey", numerals.numeral_column(price).alias("hanzi"))


@_query
def numeral_pinyin(spark, sf_dir):
    spelt = numerals.pinyin_column(numerals.cardinal_column(F.col("l_quantity")), "numbers")
    return _table(spark, sf_dir, "lineitem").select(F.explode(spelt).alias("syllable")).groupBy("syllable").agg(F.count("*").alias("n"))


@_query
def clock_reading(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(numerals.clock_column(F.hour("ts"), F.minute("ts")).alias("hanzi")).groupBy("hanzi").agg(F.count("*").alias("n"))


@_query
def year_reading(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.concat(numerals.digits_column(F.year("o_orderdate")), F.lit("年")).alias("hanzi")).groupBy("hanzi").agg(F.count("*").alias("n"))


# ---- syllables and transcriptions -----------------------------------------------------
def _syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", _pick(INVENTORY, k).alias("spelling"), (F.pmod(F.floor(k / 424), F.lit(5)) + 1).cast("int").alias("tone"))


@_query
def tone_write(spark, sf_dir):
    return columns.with_syllables(_syllables(spark, sf_dir), "spelling", "tone").select("o_orderkey", "marks", "numbers", "superscript")


@_query
def tone_strip(spark, sf_dir):
    marked = columns.with_syllables(_syllables(spark, sf_dir), "spelling", "tone")
    return marked.select("o_orderkey", columns.strip_marks(F.col("marks")).alias("toneless"), columns.tone_of_marks(F.col("marks")).alias("tone"))


@_query
def syllable_parse(spark, sf_dir):
    read = columns.parse_syllable(F.concat("spelling", F.col("tone").cast("string")))
    return _syllables(spark, sf_dir).withColumn("s", read).select("o_orderkey", F.col("s.initial").alias("initial"), F.col("s.final").alias("final"), F.col("s.tone").cast("int").alias("tone"))


@_query
def separable_start(spark, sf_dir):
    return _syllables(spark, sf_dir).groupBy(columns.opens_with_vowel(F.col("spelling")).alias("separable")).agg(F.count("*").alias("n"))


def _system(name: str) -> Query:
    def run(spark, sf_dir):
        rows = columns.with_syllables(_syllables(spark, sf_dir), "spelling", "tone")
        return rows.groupBy(F.col(name).alias("written")).agg(F.count("*").alias("n"))

    run.__name__ = f"to_{name}"
    return _query(run)


for _name in ("bopomofo", "wade_giles", "yale", "gwoyeu", "ipa"):
    _system(_name)


@_query
def transcription_ambiguity(spark, sf_dir):
    """How many syllables a toneless spelling may stand for, weighted by how often it is met."""
    rows = columns.with_syllables(_syllables(spark, sf_dir).withColumn("none", F.lit(None).cast("int")), "spelling", "none")
    table = columns.candidate_table(spark, "wade_giles").withColumnRenamed("spelling", "written")
    return rows.join(F.broadcast(table), F.col("wade_giles") == F.col("written")).groupBy(F.size("candidates").alias("candidates")).agg(F.count("*").alias("n"))


@_query
def read_candidates(spark, sf_dir):
    rows = columns.with_syllables(_syllables(spark, sf_dir), "spelling", "tone")
    return rows.select("yale").distinct().select("yale", F.array_join(columns.read_candidates(F.col("yale"), "yale"), " ").alias("candidates"))


# ---- sequences ------------------------------------------------------------------------
def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = _pick(SANDHI_TOKENS, F.col("l_partkey"))
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", token.alias("t")))).alias("s"))
    return lines.select("l_orderkey", F.transform("s", lambda x: x["t"]).alias("syllables"))


@_query
def yi_bu_sandhi(spark, sf_dir):
    return _spoken(spark, sf_dir).select("l_orderkey", F.array_join(sandhi.yi_bu_column(F.col("syllables")), " ").alias("said"))


@_query
def third_tone_flat(spark, sf_dir):
    """Third tones before third tones, read from the unchanged neighbour."""
    return _spoken(spark, sf_dir).select("l_orderkey", F.array_join(sandhi.third_tone_column(F.col("syllables")), " ").alias("said"))


@_query
def apostrophe_always(spark, sf_dir):
    word = F.array(_pick(INVENTORY, F.col("o_orderkey")), _pick(INVENTORY, F.col("o_orderkey") * 5 + 1))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(columns.apostrophes_column(word), "").alias("word"))


@_query
def latin_punctuation(spark, sf_dir):
    text = F.concat("p_name", F.lit("，"), "p_brand", F.lit("。"), "p_type", F.lit("！ 好？"))
    return _table(spark, sf_dir, "part").select("p_partkey", orthography.latin_punctuation_column(text).alias("written"))


@_query
def sentences(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("lang", orthography.is_sentence_column(F.coalesce("text", F.lit(""))).alias("sentence")).agg(F.count("*").alias("n"))


@_query
def html_escape(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(orthography.escape_html_column(F.col("html"))).alias("digest"))


@_query
def slug_ascii(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", orthography.slug_ascii_column(F.concat_ws(" / ", "p_name", "p_brand", "p_type")).alias("slug"))


# ---- glyphs and runs ------------------------------------------------------------------
def _glyph_text() -> Column:
    k = F.col("o_orderkey")
    return F.concat(*(F.substring(F.lit(GLYPHS), F.pmod(F.floor(k / d), F.lit(len(GLYPHS))).cast("int") + 1, F.lit(1)) for d in (1, 3, 10)))


@_query
def glyph_canonical(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", glyphs.canonical_column(_glyph_text()).alias("canonical"))


@_query
def glyph_hongkong(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", glyphs.hong_kong_column(glyphs.canonical_column(_glyph_text())).alias("hong_kong"))


@_query
def run_split(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit("个"), "p_name", F.lit("大小"))
    runs = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(glyphs.runs_column(text)).alias("run_no", "run"))
    return runs.select("p_partkey", "run_no", F.col("run.text").alias("text"), F.col("run.is_han").alias("is_han"))


@_query
def detect_script(spark, sf_dir):
    return _texts(spark, sf_dir).select("o_orderkey", glyphs.script_column(F.concat("text", F.when(F.col("o_orderkey") % 3 == 0, "銀銀").otherwise("")), "银长儿", "銀長兒").alias("script"))


@_query
def character_histogram(spark, sf_dir):
    """How often each character beyond ASCII is written in documents."""
    words = _table(spark, sf_dir, "documents").select(F.regexp_replace("text", r"[\x00-\x7F]", "").alias("text"))
    return script_tables.character_counts(words, "text")


@_query
def script_only_characters(spark, sf_dir):
    """Characters that only one script's words have; words of odd parts are written otherwise in the second script."""
    k = F.col("p_partkey")
    hans = _pick([*WORDS, "abc"], k)
    entries = _table(spark, sf_dir, "part").select(hans.alias("hans"), F.when(k % 2 == 0, hans).otherwise(_pick(["銀長", "兒海", "abd"], F.floor(k / 62))).alias("hant"), F.array().cast("array<string>").alias("variants"))
    hans_only, hant_only = script_tables.one_script_characters(entries)
    return hans_only.select(F.lit("h").alias("script"), "character").unionByName(hant_only.select(F.lit("H").alias("script"), "character"))


# ---- lattice --------------------------------------------------------------------------
@_query
def lattice_edges(spark, sf_dir):
    e = lattice.edges(_runs(spark, sf_dir), _dictionary(spark))
    return e.select("run_id", "start", "end", "ord", F.array_join("reading", " ").alias("reading"), F.round("cost", 4).alias("cost"))


@_query
def edge_rules(spark, sf_dir):
    """Edges that the reading rules leave."""
    runs, words = _runs(spark, sf_dir), _dictionary(spark)
    left = lattice.ruled(lattice.edges(runs, words), runs, words)
    return left.select("run_id", "start", "end", F.array_join("reading", " ").alias("reading"))


@_query
def cut_points(spark, sf_dir):
    return lattice.cut_points(lattice.edges(_runs(spark, sf_dir), _dictionary(spark)))


@_query
def reading_locks(spark, sf_dir):
    return lattice.locks(lattice.edges(_runs(spark, sf_dir), _dictionary(spark))).select("run_id", "at", "claims", "locked")


@_query
def greedy_match(spark, sf_dir):
    return lattice.greedy_words(_runs(spark, sf_dir), _dictionary(spark))


@_query
def shortest_path(spark, sf_dir):
    found = lattice.shortest_paths(lattice.edges(_runs(spark, sf_dir), _dictionary(spark)))
    return found.select("run_id", F.round("total", 4).alias("total"))


@_query
def confidence_claims(spark, sf_dir):
    return lattice.claim_costs(lattice.edges(_runs(spark, sf_dir), _dictionary(spark))).select("run_id", "start", "end", "reading", F.round("cost", 4).alias("cost"))


# ---- whole texts ----------------------------------------------------------------------
def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).withColumn("text", F.concat("text", F.lit("2个。")))


def _decoded_once(spark: SparkSession, sf_dir: str, column: Callable[[Texts, Column], Column], name: str, with_scripts: bool = False) -> DataFrame:
    """(text, orders, name): each distinct text, how many orders have it, and what is read from it; counted where the rows lie, so no row is moved for it."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # decoding is the work, so its rows are spread whatever their bytes
    # the length tells no more texts apart, but without it this exchange would stand for the next one and be coalesced
    met = _written(spark, sf_dir).groupBy("text", F.length("text").alias("length")).agg(F.count("*").alias("orders")).drop("length")
    return met.repartition(n, "text").withColumn(name, column(_operators(spark, with_scripts), F.col("text")))


def _decoded(spark: SparkSession, sf_dir: str, column: Callable[[Texts, Column], Column], name: str, with_scripts: bool = False) -> DataFrame:
    """Each distinct text is decoded once and joined back."""
    done = _decoded_once(spark, sf_dir, column, name, with_scripts)
    return _written(spark, sf_dir).join(done, "text").select("o_orderkey", "text", name)


@_query
def convert(spark, sf_dir):
    return _decoded(spark, sf_dir, lambda t, c: t.pinyin(c), "pinyin")


@_query
def convert_greedy(spark, sf_dir):
    return _decoded(spark, sf_dir, lambda t, c: t.pinyin(c, method="greedy"), "pinyin")


@_query
def convert_taiwan(spark, sf_dir):
    return _decoded(spark, sf_dir, lambda t, c: t.pinyin(c, locale="zh-TW", third_tone=True), "pinyin")


@_query
def convert_pieces(spark, sf_dir):
    # the outer form, as the inner one would have the pieces' size filtered, and so decoded, before texts are made distinct
    pieces = _decoded(spark, sf_dir, lambda t, c: t.pieces(c), "pieces").select("o_orderkey", F.posexplode_outer("pieces").alias("at", "p")).where("at is not null")
    return pieces.select("o_orderkey", "at", F.col("p.text").alias("text"), F.col("p.syllable.tone").alias("tone"), F.col("p.locked").alias("locked"), F.col("p.uncertain").alias("uncertain"), F.size("p.alternatives").alias("alternatives"))


@_query
def convert_html(spark, sf_dir):
    return _decoded(spark, sf_dir, lambda t, c: t.html(c), "html")


@_query
def convert_wade_giles(spark, sf_dir):
    return _decoded(spark, sf_dir, lambda t, c: t.system(c, "wade_giles"), "wade_giles")


@_query
def convert_bopomofo(spark, sf_dir):
    return _decoded(spark, sf_dir, lambda t, c: t.system(c, "bopomofo"), "bopomofo")


@_query
def script_to_hant(spark, sf_dir):
    return _decoded(spark, sf_dir, lambda t, c: t.script(c, "zh-Hant-HK"), "hant", with_scripts=True)


@_query
def script_choices(spark, sf_dir):
    found = _decoded_once(spark, sf_dir, lambda t, c: t.script_choices(c, "zh-Hant"), "choices", with_scripts=True)
    return found.select("orders", F.explode("choices.evidence").alias("evidence")).groupBy("evidence").agg(F.sum("orders").alias("n"))


@_query
def slug_hash(spark, sf_dir):
    return _decoded(spark, sf_dir, lambda t, c: t.slug(c, hash=True, max_length=40), "slug")


# ---- dictionary building --------------------------------------------------------------
def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose words are parts' names: a workload for the building operators."""
    part = _table(spark, sf_dir, "part")
    words = part.select(F.element_at(F.split("p_name", " "), -1).alias("hans"), F.upper(F.element_at(F.split("p_name", " "), 1)).alias("hant"), F.col("p_partkey").alias("frequency"), F.col("p_brand").alias("pos"))
    return words.select("hans", "hant", F.array().cast("array<string>").alias("variants"), F.array(F.lit("yi1")).alias("reading"), F.lit(None).cast("array<string>").alias("taiwan"), "frequency", "pos", F.lit(False).alias("proper"), F.array().cast("array<int>").alias("boundaries"), F.array().cast("array<string>").alias("alternates"))


@_query
def claim_keys(spark, sf_dir):
    return dictionaries.claim_keys(_entries(spark, sf_dir)).select("key", "frequency")


@_query
def tier_standard(spark, sf_dir):
    top = dictionaries.tier(_entries(spark, sf_dir).where(F.char_length("hans") > 1), "standard", 100)
    return top.select("hans", "frequency")


@_query
def frequency_buckets(spark, sf_dir):
    rows = dictionaries.frequency_buckets(_table(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").alias("frequency")))
    return rows.select("c_custkey", "bucket", F.round(dictionaries.cost(F.col("bucket")), 2).alias("cost"))


@_query
def argmax_tally(spark, sf_dir):
    """The most frequent ship flag of each part's brand, overall and by status, in one grouping-sets pass."""
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = lines.select(F.col("p_brand").alias("hans"), F.col("l_returnflag").alias("hant"), F.col("l_linestatus").alias("key"), F.lit("").alias("word"), F.lit(0).alias("at"))
    counts = script_tables.tally(pairs, "hans", "hant")
    return counts.select(F.col("source").alias("brand"), "key", F.col("to").alias("flag"), "count")


@_query
def name_boundaries(spark, sf_dir):
    tokens = F.transform(F.split("p_name", " "), lambda t, k: F.when(F.pmod(F.col("p_partkey") + k, F.lit(3)) == 0, F.initcap(t)).otherwise(t))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(parsers.name_boundaries(tokens).cast("array<string>"), ".").alias("boundaries"))


CEDICT = """# a comment
銀行 银行 [yin2 hang2] /bank/
大夫 大夫 [dai4 fu5] /doctor/
玩兒 玩儿 [wan2 r5] /to play/
垃圾 垃圾 [la1 ji1] /trash/Taiwan pr. [le4 se4]/
北京 北京 [Bei3 jing1] /Beijing/
頭髮 头发 [tou2 fa5] /hair/
毛澤東 毛泽东 [Mao2 Ze2 dong1] /person/
囗囗 囗囗 [xx5 xx5] /unknown/
垃圾桶 垃圾桶 [la1 ji1 tong3] /bin/
"""
FREQUENCIES = "银行 5200 n\n北京 30000 ns\n大夫 900 n\n垃圾 1200 n\n毛泽东 2000 nr\n垃圾 1250 n\nbad x n\n"
PHRASES = "银行: yín háng # note\n头发: tóu fà\n玩儿: wán ér\nabc: a b c\n"
UNIHAN = "U+94F6\tkMandarin\tyín\nU+884C\tkHanyuPinlu\txíng(100) háng(200)\nU+884C\tkMandarin\txíng\nU+53D1\tkMandarin\tfā\nU+5783\tkMandarin\tlā lè\nU+5934\tkMandarin\ttóu\nU+6876\tkMandarin\ttǒng\n"
VARIANTS = "U+5934\tkTraditionalVariant\tU+982D\nU+94F6\tkTraditionalVariant\tU+9280\n"


def merged_fixture(spark: SparkSession) -> DataFrame:
    line = lambda text: parsers.lines_of(spark, text)
    return merge.merge(parsers.unihan_readings(line(UNIHAN)), parsers.unihan_variants(line(VARIANTS)), parsers.phrases(line(PHRASES)), parsers.cedict(line(CEDICT)), parsers.frequencies(line(FREQUENCIES)))


@_query
def merge_sources(spark, sf_dir):
    """Hand-written source lines, merged, with Taiwan readings composed."""
    entries = merged_fixture(spark).where("hant is not null").drop("events")
    return merge.compose_taiwan(entries).select("hans", "hant", F.array_join("reading", " ").alias("reading"), F.array_join("taiwan", " ").alias("taiwan"), "frequency", "pos", "proper")


@_query
def build_script_tables(spark, sf_dir):
    return script_tables.written(script_tables.build(dictionaries.sample_entries(spark)))


@_query
def stored_dictionary(spark, sf_dir):
    return dictionaries.stored_lines(dictionaries.sample_entries(spark))


@_query
def dictionary_lookup(spark, sf_dir):
    words = _texts(spark, sf_dir).select(F.substring("text", 1, 2).alias("word"))
    found = dictionaries.lookup(words, _dictionary(spark))
    return found.groupBy("word").agg(F.count("*").alias("n"), F.first(F.array_join("reading", " ")).alias("reading"))


# ---- metrics --------------------------------------------------------------------------
@_query
def accuracy_report(spark, sf_dir):
    """The greedy decode against the lattice decode."""
    texts, t = _texts(spark, sf_dir).select("text").distinct(), _operators(spark)
    both = texts.select(t.pinyin(F.col("text")).alias("expected"), t.pinyin(F.col("text"), method="greedy").alias("actual"))
    rows = metrics.report(metrics.scored(both, "expected", "actual"))
    return rows.select(*(F.round(c, 6).alias(c) for c in rows.columns))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's words in pinyin, as the lattice reads them."""
    return convert(spark, sf_dir)


__all__ = ["Options", "flagship", "merged_fixture", "queries"]
