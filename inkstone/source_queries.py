"""Queries over lexical sources, written words and metrics, and their SQL.

Source lines are written from keys of the driver's tables, well and ill formed ones by
turns; the SQL knows what a line was written from and never parses it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns, romanise
from .functions.phonology import INVENTORY
from .operators import dictionary as dictionaries
from .operators import metrics
from .sources import parsers

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}
HANS, HANT = "银行 长大 玩儿 海鸥 西安 垃圾".split(), "銀行 長大 玩兒 海鷗 西安 垃圾".split()
CHARACTERS = "银行长大玩儿海西安好"
TAGS = ["n", "nr", "ns", "v", "nz", ""]
FIELDS = ["kHanyuPinlu", "kMandarin", "kXHC1983", "kTGHZ2013", "kOther"]
CONVERSIONS = ["t", "s", "w", "x", "h", "H", "z"]
SYSTEMS = ("bopomofo", "wade_giles", "yale", "gwoyeu", "ipa")


def _query(function: Query) -> Query:
    _found[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_found)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(items, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in items)), (F.pmod(index, F.lit(len(items))) + 1).cast("int"))


def _lines(spark: SparkSession, sf_dir: str, value: Callable[[Column], Column], table: str = "orders", key: str = "o_orderkey") -> DataFrame:
    return _table(spark, sf_dir, table).select(F.col(key).cast("bigint").alias("ord"), value(F.col(key)).alias("value"))


def _spelt(k: Column, by: int = 1) -> Column:
    return _pick(INVENTORY, k * by + (by - 1))


# ---- sources --------------------------------------------------------------------------
@_query
def parse_cedict(spark, sf_dir):
    def line(k: Column) -> Column:
        first = F.when(k % 4 == 0, F.initcap(_spelt(k))).otherwise(_spelt(k))
        note = F.lit("Taiwan pr. [le4 se4]")
        senses = F.when(k % 5 == 0, F.concat(F.lit("one/"), note)).when(k % 5 == 1, F.concat(F.lit("one ("), note, F.lit(")/two"))).when(k % 5 == 2, F.concat(F.lit("one/two ("), note, F.lit(")"))).otherwise("one/two/three")
        entry = F.concat(_pick(HANT, k), F.lit(" "), _pick(HANS, k), F.lit(" ["), first, F.lit("1 "), _spelt(k, 5), F.lit("4] /"), senses, F.lit("/"))
        unknown = F.concat(_pick(HANT, k), F.lit(" x [xx5 xx5] /unknown/"))
        return F.when(k % 11 == 0, "# a remark").when(k % 13 == 0, "no entry [at all] here").when(k % 17 == 0, unknown).otherwise(entry)

    found = parsers.cedict(_lines(spark, sf_dir, line))
    return found.select("ord", "traditional", "simplified", F.array_join("readings", " ").alias("readings"), "proper", F.array_join("taiwan", " ").alias("taiwan"), "scope", F.size("definitions").alias("senses"))


@_query
def parse_frequencies(spark, sf_dir):
    line = lambda k: F.concat_ws(" ", _pick([*HANS, "北京"], k), F.when(k % 9 == 0, "many").otherwise(k.cast("string")), _pick(TAGS, F.floor(k / 3)))
    return parsers.frequencies(_lines(spark, sf_dir, line)).select("word", F.col("frequency").cast("bigint").alias("frequency"), "pos", parsers.is_proper_tag(F.col("pos")).alias("proper"))


@_query
def parse_phrases(spark, sf_dir):
    word = lambda k: F.when(k % 9 == 0, "abc").otherwise(_pick([*HANS, "北京"], k))
    body = lambda k: F.when(k % 10 == 0, "# nothing").otherwise(F.concat(_spelt(k), F.lit(" "), _spelt(k, 5), F.when(k % 2 == 0, " # a note").otherwise("")))
    found = parsers.phrases(_lines(spark, sf_dir, lambda k: F.concat(word(k), F.lit(": "), body(k))))
    return found.select("word", F.array_join("readings", " ").alias("readings"))


def _point(c: Column) -> Column:
    return F.concat(F.lit("U+"), F.hex(F.codepoint_at(c) if hasattr(F, "codepoint_at") else F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("bigint")))


@_query
def parse_unihan_readings(spark, sf_dir):
    def line(k: Column) -> Column:
        a, b = _spelt(F.floor(k / 7)), _spelt(F.floor(k / 7), 5)
        value = F.when(k % 5 == 0, F.concat(a, F.lit("(3) "), b, F.lit("(9)"))).when(k % 5 == 1, F.concat(a, F.lit(" "), b)).when(k % 5 == 2, F.concat(F.lit("0001.010:"), a, F.lit(","), b)).otherwise(F.concat(F.lit("0002.020:"), b))
        return F.concat(_point(_pick(CHARACTERS, F.floor(k / 5))), F.lit("\t"), _pick(FIELDS, k), F.lit("\t"), value)

    return parsers.unihan_readings(_lines(spark, sf_dir, line)).select("character", F.array_join("readings", " ").alias("readings"), "taiwan", F.size("fields").alias("fields"))


@_query
def parse_unihan_variants(spark, sf_dir):
    kind = lambda k: F.when(k % 3 == 0, "kSimplifiedVariant").when(k % 3 == 1, "kTraditionalVariant").otherwise("kZVariant")
    value = lambda k: F.concat(_point(_pick(CHARACTERS, k)), F.lit("\t"), kind(k), F.lit("\t"), _point(_pick(CHARACTERS, k + 1)), F.lit(" "), F.when(k % 2 == 0, "no point").otherwise(_point(_pick(CHARACTERS, k + 3))))
    found = parsers.unihan_variants(_lines(spark, sf_dir, value, "part", "p_partkey"))
    return found.select("character", "kind", F.array_join("variants", "").alias("variants"))


@_query
def parse_opencc(spark, sf_dir):
    value = lambda k: F.when(k % 7 == 0, F.concat(F.lit("#"), _pick(CHARACTERS, k))).otherwise(F.concat(_pick(CHARACTERS, k), F.lit("\t"), _pick(HANT, k), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit(" "), _pick(HANS, k)))))
    table = parsers.opencc(_lines(spark, sf_dir, value))
    return table.join(parsers.opencc_default(table), "character").select("character", F.array_join("forms", " ").alias("forms"), "form")


@_query
def parse_conversions(spark, sf_dir):
    value = lambda k: F.concat_ws("\t", _pick(CONVERSIONS, k), F.when(k % 9 == 0, "").otherwise(_pick(HANS, k)), _pick(HANT, k), F.when(k % 2 == 0, F.concat(_spelt(k), F.lit("=一,broken"))).otherwise(""), F.when(k % 3 == 0, "長兒").otherwise(""))
    found = parsers.conversion_lines(_lines(spark, sf_dir, value))
    entries = F.transform(F.map_entries("readings"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.groupBy("tag", "source", "to", F.array_join(entries, ",").alias("readings"), F.array_join("also", " ").alias("also")).agg(F.count("*").alias("n"))


@_query
def frequency_blob(spark, sf_dir):
    """Buckets of customers' balances, packed by market segment and read back."""
    rows = dictionaries.frequency_buckets(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.floor("c_acctbal").alias("frequency")))
    own = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "bucket"))), lambda r: r["bucket"])
    blobs = rows.groupBy("c_mktsegment").agg(dictionaries.packed(own).alias("blob"))
    return blobs.select("c_mktsegment", F.length("blob").alias("bytes"), F.array_join(parsers.packed_buckets(F.col("blob")).cast("array<string>"), " ").alias("buckets"))


# ---- written words --------------------------------------------------------------------
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two syllables a row, in marks: the tones of the first go through 1 to 4."""
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", _spelt(k).alias("a"), (F.pmod(F.floor(k / 424), F.lit(4)) + 1).cast("int").alias("ta"), _spelt(k, 5).alias("b"), (F.pmod(k, F.lit(4)) + 1).cast("int").alias("tb"))
    one = columns.with_syllables(rows, "a", "ta").select("o_orderkey", "b", "tb", F.col("marks").alias("first"))
    return columns.with_syllables(one, "b", "tb").select("o_orderkey", "first", F.col("marks").alias("second"))


@_query
def split_words(spark, sf_dir):
    split = columns.split_word(F.concat("first", F.lit("'"), "second"))
    return _pairs(spark, sf_dir).select("o_orderkey", F.array_join(split, " ").alias("syllables"))


@_query
def words_in_systems(spark, sf_dir):
    word = F.concat("first", F.lit("'"), "second")
    return _pairs(spark, sf_dir).select("o_orderkey", *(columns.transcribe(word, s).alias(s) for s in SYSTEMS))


@_query
def syllable_notations(spark, sf_dir):
    """ü written u: and superscript tones are read like the usual notation."""
    k = F.col("o_orderkey")
    tone = F.pmod(F.floor(k / 424), F.lit(5)) + 1
    text = F.concat(F.regexp_replace(_spelt(k), "ü", "u:"), _pick("¹²³⁴⁵", tone - 1))
    read = _table(spark, sf_dir, "orders").withColumn("s", columns.parse_syllable(text))
    return read.select("o_orderkey", F.col("s.initial").alias("initial"), F.col("s.final").alias("final"), F.col("s.tone").cast("int").alias("tone"))


def _readers(system: str) -> Query:
    def run(spark, sf_dir):
        k = F.col("o_orderkey")
        rows = _table(spark, sf_dir, "orders").select(_spelt(k).alias("spelling"), (F.pmod(F.floor(k / 424), F.lit(4)) + 1).cast("int").alias("tone"))
        written = columns.with_syllables(rows, "spelling", "tone").select(F.col(system).alias("written"), "numbers").distinct()
        read = F.array_contains(columns.read_candidates(F.col("written"), system), F.col("numbers"))
        return written.groupBy(read.alias("recovered")).agg(F.count("*").alias("n"))

    run.__name__ = f"read_{system}"
    return _query(run)


for _name in SYSTEMS:
    _readers(_name)


# ---- metrics --------------------------------------------------------------------------
@_query
def accuracy_cases(spark, sf_dir):
    """Words said rightly, with another tone, written together, or cut short, by turns."""
    k = F.col("o_orderkey")
    other = columns.apply_tone(columns.strip_marks(F.col("first")), F.when(columns.tone_of_marks(F.col("first")) == 1, 2).otherwise(1))
    said = F.when(k % 4 == 0, F.concat_ws(" ", "first", "second")).when(k % 4 == 1, F.concat_ws(" ", other, "second")).when(k % 4 == 2, F.concat_ws("'", "first", "second")).otherwise(F.col("first"))
    cases = _pairs(spark, sf_dir).select(F.concat_ws(" ", "first", "second").alias("expected"), said.alias("actual"))
    rows = metrics.report(metrics.scored(cases, "expected", "actual"))
    return rows.select(*(F.round(c, 6).alias(c) for c in rows.columns))


# ---- SQL ------------------------------------------------------------------------------
def _list(items) -> str:
    return "[" + ", ".join("'" + x + "'" for x in items) + "]"


def _at(items, index: str) -> str:
    return f"({_list(items)})[({index}) % {len(items)} + 1]"


def _syllable(k: str, by: int = 1) -> str:
    return _at(INVENTORY, f"{k} * {by} + {by - 1}")


def _sounds(*names: str) -> str:
    head = "spelling tone erhua initial final marks numbers superscript toneless bopomofo wade_giles yale gwoyeu ipa".split()
    at = [head.index(c) for c in ("spelling", "tone", *names)]
    rows = [[r[k] for k in at] for r in columns.syllable_rows() if not r[2] and r[1] is not None]
    text = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t(spelling, tone{''.join(', ' + n for n in names)})"


def _last(rows: str, key: str, *names: str) -> str:
    return f"SELECT {key}, {', '.join(f'arg_max({n}, ord) AS {n}' for n in names)} FROM ({rows}) GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    k = "o_orderkey"
    scope = f"CASE {k} % 5 WHEN 0 THEN 'entry' WHEN 1 THEN 'leading' WHEN 2 THEN 'sense' END"
    halved = f"{k} // 7"
    field = f"SELECT {_at(CHARACTERS, f'{k} // 5')} AS character, {k} % 5 AS f, arg_max({_syllable(f'({halved})')}, {k}) AS a, arg_max({_syllable(f'({halved})', 5)}, {k}) AS b FROM orders WHERE {k} % 5 < 4 GROUP BY 1, 2"
    listed = "SELECT character, unnest(CASE f WHEN 0 THEN [b, a] WHEN 1 THEN [a] WHEN 2 THEN [a, b] ELSE [b] END) AS r, unnest(CASE f WHEN 0 THEN [0, 1] WHEN 1 THEN [20] WHEN 2 THEN [30, 31] ELSE [10] END) AS place FROM f"
    pair = f"SELECT {k}, {_syllable(k)} AS a, ({k} // 424) % 4 + 1 AS ta, {_syllable(k, 5)} AS b, {k} % 4 + 1 AS tb FROM orders"
    both = lambda *names: f"FROM ({pair}) p JOIN {_sounds(*names).replace('AS t(', 'AS x(')} ON x.spelling = p.a AND x.tone = p.ta JOIN {_sounds(*names).replace('AS t(', 'AS y(')} ON y.spelling = p.b AND y.tone = p.tb"
    joints = {s: romanise.SYSTEMS[s][1] for s in SYSTEMS}
    variant = f"SELECT {_at(CHARACTERS, 'p_partkey')} AS character, CASE p_partkey % 3 WHEN 0 THEN 'simplified' ELSE 'traditional' END AS kind, p_partkey AS ord, {_at(CHARACTERS, 'p_partkey + 1')} || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE {_at(CHARACTERS, 'p_partkey + 3')} END AS v FROM part WHERE p_partkey % 3 < 2"
    sql = {
        "parse_cedict": f"""SELECT {k} AS ord, {_at(HANT, k)} AS traditional, {_at(HANS, k)} AS simplified, CASE WHEN {k} % 4 = 0 THEN upper(substr({_syllable(k)}, 1, 1)) || substr({_syllable(k)}, 2) ELSE {_syllable(k)} END || '1 ' || {_syllable(k, 5)} || '4' AS readings,
{k} % 4 = 0 AS proper, CASE WHEN {k} % 5 < 3 THEN 'le4 se4' END AS taiwan, {scope} AS scope, CASE WHEN {k} % 5 < 3 THEN 2 ELSE 3 END AS senses FROM orders WHERE {k} % 11 <> 0 AND {k} % 13 <> 0 AND {k} % 17 <> 0""",
        "parse_frequencies": _last(f"SELECT {k} AS ord, {_at([*HANS, '北京'], k)} AS word, {k} AS frequency, {_at(TAGS, f'{k} // 3')} AS pos, {_at(TAGS, f'{k} // 3')} IN ('nr', 'ns', 'nz') AS proper FROM orders WHERE {k} % 9 <> 0", "word", "frequency", "pos", "proper"),
        "parse_phrases": _last(f"SELECT {k} AS ord, {_at([*HANS, '北京'], k)} AS word, {_syllable(k)} || ' ' || {_syllable(k, 5)} AS readings FROM orders WHERE {k} % 9 <> 0 AND {k} % 10 <> 0", "word", "readings"),
        "parse_unihan_readings": f"WITH f AS ({field}), l AS ({listed}) SELECT character, readings, taiwan, CAST(fields AS INT) AS fields FROM (SELECT character, string_agg(r, ' ' ORDER BY place) AS readings FROM (SELECT character, r, min(place) AS place FROM l GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT character, max(CASE WHEN f = 1 AND a <> b THEN b END) AS taiwan, count(*) AS fields FROM f GROUP BY 1) USING (character)",
        "parse_unihan_variants": f"SELECT character, kind, string_agg(v, '' ORDER BY ord) AS variants FROM ({variant}) GROUP BY 1, 2",
        "parse_opencc": _last(f"SELECT {k} AS ord, {_at(CHARACTERS, k)} AS character, {_at(HANT, k)} || CASE WHEN {k} % 2 = 0 THEN '' ELSE ' ' || {_at(HANS, k)} END AS forms, {_at(HANT, k)} AS form FROM orders WHERE {k} % 7 <> 0", "character", "forms", "form"),
        "parse_conversions": f"""SELECT {_at(CONVERSIONS, k)} AS tag, {_at(HANS, k)} AS source, {_at(HANT, k)} AS "to", CASE WHEN {k} % 2 = 0 THEN {_syllable(k)} || '=一' ELSE '' END AS readings, CASE WHEN {k} % 3 = 0 THEN '長 兒' ELSE '' END AS also, count(*) AS n FROM orders WHERE {k} % 9 <> 0 AND {k} % 7 <> 6 GROUP BY 1, 2, 3, 4, 5""",
        "frequency_blob": """SELECT c_mktsegment, CAST((count(*) + 1) // 2 AS INT) AS bytes, string_agg(bucket, ' ' ORDER BY c_custkey) || CASE WHEN count(*) % 2 = 1 THEN ' 0' ELSE '' END AS buckets FROM (
SELECT c_custkey, c_mktsegment, CAST(CAST(least(15, floor(ln(1 + greatest(floor(c_acctbal), 0)) * (15 / ln(1 + (SELECT max(floor(c_acctbal)) FROM customer))) + 0.5)) AS INT) AS VARCHAR) AS bucket FROM customer) GROUP BY 1""",
        "split_words": f"SELECT {k}, x.marks || ' ' || y.marks AS syllables {both('marks')}",
        "words_in_systems": f"SELECT {k}, " + ", ".join(f"x.{s} || '{joints[s]}' || y.{s} AS {s}" for s in SYSTEMS) + f" {both(*SYSTEMS)}",
        "syllable_notations": f"SELECT {k}, initial, final, CAST(tone AS INT) AS tone FROM (SELECT {k}, {_syllable(k)} AS spelling, ({k} // 424) % 5 + 1 AS tone FROM orders) JOIN {_sounds('initial', 'final')} USING (spelling, tone)",
        "accuracy_cases": f"""WITH c AS (SELECT count(*) FILTER (k = 0) AS same, count(*) FILTER (k = 1) AS tone, count(*) FILTER (k = 2) AS joined, count(*) FILTER (k = 3) AS short FROM (SELECT {k} % 4 AS k FROM orders)),
s AS (SELECT *, same + tone + joined + short AS n, 2.0 * (same + tone + joined) + short AS bases, 2.0 * (same + tone) + joined + short AS hits FROM c), r AS (SELECT *, 100 * hits / (2.0 * (same + tone) + joined + short) AS precision, 100 * hits / (2.0 * n) AS recall FROM s)
SELECT round(100.0 * same / n, 6) AS exact, round(100 * (bases - tone) / (2.0 * n), 6) AS readings, round(100 * bases / (2.0 * n), 6) AS bases, round(100 * (bases - tone) / bases, 6) AS tones, round(100 * bases / (2.0 * n), 6) AS capitals, round(2 * precision * recall / (precision + recall), 6) AS spacing FROM r""",
    }
    for s in SYSTEMS:
        sql[f"read_{s}"] = f"SELECT true AS recovered, count(*) AS n FROM (SELECT DISTINCT {s}, numbers FROM (SELECT {_syllable(k)} AS spelling, ({k} // 424) % 4 + 1 AS tone FROM orders) JOIN {_sounds(s, 'numbers')} USING (spelling, tone))"
    return sql
