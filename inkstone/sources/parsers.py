"""Lexical sources as DataFrames: each parser takes lines (ord, value) and keeps what is well formed."""

from __future__ import annotations

import io
import unicodedata
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Reading fields, the most trusted first.
READING_FIELDS = ("kHanyuPinlu", "kTGHZ2013", "kMandarin", "kXHC1983")
PROPER_TAGS = ("nr", "ns", "nt", "nz")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of a text file; ord grows with the line's place."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "ord bigint, value string")


def zip_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(ord, value) of one member of zip archives; an archive is one task's."""

    def run(batches):
        for batch in batches:
            for content in batch.content:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    for text in (archive.read(n).decode() for n in archive.namelist() if n.split("/")[-1] == member):
                        own = text.split("\n")
                        yield pd.DataFrame({"ord": range(len(own)), "value": own})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "ord bigint, value string")


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def capitalised(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    return first != F.lower(first)


def name_boundaries(tokens: Column) -> Column:
    """Places of inner capitalised syllables, where the first one is capitalised too."""
    inner = F.filter(F.sequence(F.lit(1), F.size(tokens) - 1), lambda k: capitalised(F.get(tokens, k)))
    return F.when((F.size(tokens) > 1) & capitalised(F.get(tokens, F.lit(0))), inner).otherwise(F.array().cast("array<int>")).cast("array<int>")


def taiwan_scope(definitions: Column) -> Column:
    """entry: the note is a definition of its own; leading: the first sense has it; sense: a later one; null: none."""
    noted = F.transform(definitions, lambda d: d.rlike(r"Taiwan pr\. \[[^\]]+\]"))
    alone = F.exists(definitions, lambda d: d.rlike(r"Taiwan pr\. \[[^\]]+\]") & d.rlike(r"^[\w.-]+ pr\. \["))
    return F.when(~F.exists(noted, lambda x: x), None).when(alone, "entry").when(F.get(noted, F.lit(0)), "leading").otherwise("sense")


def cedict(source: DataFrame) -> DataFrame:
    """(ord, traditional, simplified, readings, proper, taiwan, scope, definitions)."""
    shape = r"^(\S+)\s+(\S+)\s+\[([^\]]*)\]\s+/(.*)/\s*$"
    part = lambda k: F.regexp_extract("value", shape, k)
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    found = source.where(~F.col("value").startswith("#") & F.col("value").rlike(shape)).select("ord", nfc(part(1)).alias("traditional"), nfc(part(2)).alias("simplified"), words(part(3)).alias("readings"), F.filter(F.split(part(4), "/"), lambda x: x != "").alias("definitions"), words(F.regexp_extract(part(4), r"Taiwan pr\. \[([^\]]+)\]", 1)).alias("noted"))
    found = found.where((F.size("readings") > 0) & ~F.exists("readings", lambda r: r.rlike(r"^xx[0-9]?$")))
    scope = taiwan_scope(F.col("definitions"))
    has = (F.size("noted") > 0) & scope.isNotNull()
    return found.select("ord", "traditional", "simplified", "readings", capitalised(F.get("readings", F.lit(0))).alias("proper"), F.when(has, F.col("noted")).alias("taiwan"), F.when(has, scope).alias("scope"), "definitions")


def _last(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The last line of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), "ord").alias("_")).select(key, *(F.col(f"_.{c}").alias(c) for c in columns))


def frequencies(source: DataFrame) -> DataFrame:
    """(word, frequency, pos) of ``word count [tag]`` lines; counts that are no number are dropped, the last line of a word counts."""
    cells = F.split(F.trim("value"), " ")
    rows = source.select("ord", nfc(F.get(cells, F.lit(0))).alias("word"), F.get(cells, F.lit(1)).try_cast("double").alias("frequency"), F.coalesce(F.get(cells, F.lit(2)), F.lit("")).alias("pos"))
    rows = rows.where((F.col("word") != "") & F.col("frequency").isNotNull() & ~F.isnan("frequency") & (F.abs("frequency") < float("inf")))
    return _last(rows, "word", "frequency", "pos")


def is_proper_tag(tag: Column) -> Column:
    return tag.isin(*PROPER_TAGS)


def phrases(source: DataFrame) -> DataFrame:
    """(word, readings) of ``word: py py # note`` lines whose word is all Han."""
    word = nfc(F.trim(F.regexp_extract("value", "^([^:]*):", 1)))
    body = F.regexp_replace(F.regexp_extract("value", "^[^:]*:(.*)$", 1), "#.*$", "")
    rows = source.where(F.col("value").contains(":")).select("ord", word.alias("word"), F.filter(F.split(nfc(F.trim(body)), r"\s+"), lambda x: x != "").alias("readings"))
    return _last(rows.where(F.col("word").rlike(r"^\p{IsHan}+$") & (F.size("readings") > 0)), "word", "readings")


@F.pandas_udf(T.StringType())
def _character(values: pd.Series) -> pd.Series:
    """The character of a hexadecimal code point."""
    return values.map(lambda v: None if not v else chr(int(v, 16)))


def field_readings(field: Column, value: Column) -> Column:
    """The readings of a field's value: counted ones by falling count, others without their places."""
    tokens = F.filter(F.split(value, r"\s+"), lambda x: x != "")
    counted = F.filter(tokens, lambda t: t.rlike(r"^.+\([0-9]+\)$"))
    ranked = F.array_sort(F.transform(counted, lambda t, k: F.struct((-F.regexp_extract(t, r"\(([0-9]+)\)$", 1).cast("bigint")).alias("n"), k.alias("k"), F.regexp_extract(t, r"^(.+)\([0-9]+\)$", 1).alias("r"))))
    plain = F.flatten(F.transform(tokens, lambda t: F.split(F.when(t.contains(":"), F.get(F.split(t, ":"), F.lit(1))).otherwise(t), ",")))
    return F.when(field == READING_FIELDS[0], F.transform(ranked, lambda s: s["r"])).otherwise(F.filter(plain, lambda r: r != ""))


def unihan_readings(source: DataFrame) -> DataFrame:
    """(character, readings, fields, taiwan): readings of all fields by trust, without repeats; the second kMandarin reading is Taiwan's."""
    shape = r"^U\+([0-9A-F]+)\t(\w+)\t(.+)$"
    rows = source.where(F.col("value").rlike(shape)).select("ord", F.regexp_extract("value", shape, 1).alias("point"), F.regexp_extract("value", shape, 2).alias("field"), F.regexp_extract("value", shape, 3).alias("raw"))
    rows = rows.where(F.col("field").isin(*READING_FIELDS)).withColumn("found", field_readings(F.col("field"), F.col("raw"))).where(F.size("found") > 0)
    main = F.col("field") == "kMandarin"
    second = F.get("found", F.lit(1))
    rows = rows.select("ord", _character(F.col("point")).alias("character"), "field", F.when(main, F.slice("found", 1, 1)).otherwise(F.col("found")).alias("readings"), F.when(main & (second != F.get("found", F.lit(0))), second).alias("taiwan"))
    last = rows.groupBy("character", "field").agg(F.max_by(F.struct("readings", "taiwan"), "ord").alias("l")).select("character", "field", "l.*")
    rank = F.create_map(*(F.lit(x) for k, f in enumerate(READING_FIELDS) for x in (f, k)))
    by = last.groupBy("character").agg(F.array_sort(F.collect_list(F.struct(rank[F.col("field")].alias("rank"), "field", "readings"))).alias("fields"), F.max("taiwan").alias("taiwan"))
    return by.select("character", F.array_distinct(F.flatten(F.transform("fields", lambda f: f["readings"]))).alias("readings"), "fields", "taiwan")


def unihan_variants(source: DataFrame) -> DataFrame:
    """(character, kind, variants); kind: simplified or traditional."""
    shape = r"^U\+([0-9A-F]+)\t(kSimplifiedVariant|kTraditionalVariant)\t(.+)$"
    rows = source.where(F.col("value").rlike(shape)).select("ord", _character(F.regexp_extract("value", shape, 1)).alias("character"), F.when(F.regexp_extract("value", shape, 2) == "kSimplifiedVariant", "simplified").otherwise("traditional").alias("kind"), F.posexplode(F.split(F.regexp_extract("value", shape, 3), r"\s+")).alias("at", "token"))
    rows = rows.where(F.col("token").rlike(r"^U\+[0-9A-F]+$")).withColumn("variant", _character(F.substring("token", 3, 8)))
    return rows.groupBy("character", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "at", "variant"))), lambda s: s["variant"]).alias("variants"))


def opencc(source: DataFrame) -> DataFrame:
    """(character, forms) of ``key<TAB>form form`` lines; the first form is the default."""
    cells = F.split(F.trim("value"), "\t")
    rows = source.where(~F.col("value").startswith("#")).select("ord", nfc(F.get(cells, F.lit(0))).alias("character"), F.filter(F.split(nfc(F.get(cells, F.lit(1))), " "), lambda x: x != "").alias("forms"))
    return _last(rows.where((F.col("character") != "") & (F.size("forms") > 0)), "character", "forms")


def opencc_default(table: DataFrame) -> DataFrame:
    return table.select("character", F.get("forms", F.lit(0)).alias("form"))


def tier_files(tier: str) -> dict[str, str]:
    """The names of a stored tier's three files."""
    return {part: f"{tier}.{end}" for part, end in (("keys", "keys"), ("entries", "entries"), ("frequencies", "freq"))}


def packed_buckets(content: Column) -> Column:
    """The buckets of packed bytes, two a byte, the first in the high half; an odd number leaves a last 0."""
    return F.transform(F.filter(F.split(F.hex(content), ""), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))


def stored_dictionary(spark: SparkSession, keys: str, entries: str, frequencies: str | None = None) -> DataFrame:
    """(key, line), and with frequencies bucket, of parallel files, matched by line number; a key beyond the frequencies has bucket 0."""

    def numbered(path: str, name: str) -> DataFrame:
        return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", name))

    lines = numbered(keys, "key").join(numbered(entries, "line"), "at")
    if frequencies is None:
        return lines.select("key", "line")
    packed = spark.read.format("binaryFile").load(frequencies).select(F.posexplode(packed_buckets(F.col("content"))).alias("at", "bucket"))
    return lines.join(packed, "at", "left").select("key", "line", F.coalesce("bucket", F.lit(0)).alias("bucket"))


def stored_tier(spark: SparkSession, folder: str, tier: str) -> DataFrame:
    """(key, line, bucket) of a tier's files in a folder."""
    return stored_dictionary(spark, *(f"{folder}/{name}" for name in tier_files(tier).values()))


def conversion_lines(source: DataFrame) -> DataFrame:
    """(tag, source, to, readings, also) of tab-separated conversion tables; unknown tags are left out."""
    cells = F.split("value", "\t", -1)
    cell = lambda k: F.coalesce(F.get(cells, F.lit(k)), F.lit(""))
    pairs = F.filter(F.transform(F.split(cell(3), ","), lambda x: F.split(x, "=")), lambda x: F.coalesce(F.get(x, F.lit(1)), F.lit("")) != "")
    rows = source.where(cell(0).isin("t", "s", "w", "x", "h", "H") & (cell(1) != ""))
    return rows.select(cell(0).alias("tag"), cell(1).alias("source"), cell(2).alias("to"), F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.get(x, F.lit(0)), F.get(x, F.lit(1))))).alias("readings"), F.when(cell(4) != "", F.split(cell(4), "")).otherwise(F.array().cast("array<string>")).alias("also"))
