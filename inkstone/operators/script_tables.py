"""Script conversion tables from entries: tallies of paired characters, exceptions, and characters of one script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.glyphs import canonical_column
from ..plans.convert import Conversion, ScriptTables

READING_AGREEMENT, RIVAL_SHARE = 0.8, 0.05


def pairings(entries: DataFrame) -> DataFrame:
    """(hans, hant, key, word, at): characters side by side; key is the syllable in numbers, or empty where it is unknown."""
    same = entries.where(F.char_length("hans") == F.char_length("hant")).select(F.col("hans").alias("word"), "hant", "reading")
    bare = F.regexp_replace(F.get("reading", F.col("at")), "r([0-5]?)$", "$1")
    key = F.when(F.size("reading") == F.char_length("word"), F.when(F.get("reading", F.col("at")).rlike("^er[0-5]?$"), F.get("reading", F.col("at"))).otherwise(bare)).otherwise("")
    rows = same.select("word", "hant", "reading", F.posexplode(F.split("word", "")).alias("at", "from"))
    return rows.select(F.col("from").alias("hans"), F.substring("hant", F.col("at") + 1, F.lit(1)).alias("hant"), key.alias("key"), "word", "at")


def tally(pairs: DataFrame, source: str, to: str) -> DataFrame:
    """(source, key, to, count, first): how often each form stands for a character, for each reading and (key '*') for any.

    One grouping-sets pass; rows whose reading is unknown count for any reading only.
    """
    rows = pairs.select(F.col(source).alias("source"), F.col(to).alias("to"), "key", F.struct("word", "at").alias("place"))
    counted = rows.groupingSets([["source", "to", "key"], ["source", "to"]], "source", "to", "key").agg(F.count("*").alias("count"), F.min("place").alias("first"), F.grouping("key").alias("any"))
    return counted.where((F.col("any") == 1) | (F.col("key") != "")).select("source", F.when(F.col("any") == 1, "*").otherwise(F.col("key")).alias("key"), "to", "count", "first")


def commonest(counts: DataFrame) -> DataFrame:
    """(source, key, form, share): the most counted form; of equal ones another form than the character itself, then the one met first."""
    order = Window.partitionBy("source", "key").orderBy(F.desc("count"), F.col("to") == F.col("source"), "first")
    whole = Window.partitionBy("source", "key")
    ranked = counts.withColumn("rank", F.row_number().over(order)).withColumn("total", F.sum("count").over(whole))
    return ranked.where("rank = 1").select("source", "key", F.col("to").alias("form"), (F.col("count") / F.col("total")).alias("share"))


def conversions(pairs: DataFrame, source: str, to: str) -> DataFrame:
    """(source, to, by_reading, also) of characters that convert, or could."""
    counts = tally(pairs, source, to)
    best = commonest(counts)
    overall = best.where("key = '*'").select("source", F.col("form").alias("to"))
    apart = best.where("key <> '*'").join(overall, "source").where((F.col("form") != F.col("to")) & (F.col("share") >= READING_AGREEMENT))
    by = apart.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "form")))).alias("by_reading"))
    whole = Window.partitionBy("source")
    rivals = counts.where("key = '*'").withColumn("total", F.sum("count").over(whole)).where(F.col("count") / F.col("total") >= RIVAL_SHARE).join(overall.withColumnRenamed("to", "chosen"), "source").join(by, "source", "left")
    settled = F.coalesce(F.array_contains(F.map_values("by_reading"), F.col("to")), F.lit(False))
    rivals = rivals.where((F.col("to") != F.col("chosen")) & ~settled)
    also = rivals.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "first", "to"))), lambda x: x["to"]).alias("also"))
    out = overall.join(by, "source", "left").join(also, "source", "left")
    return out.where((F.col("source") != F.col("to")) | F.col("by_reading").isNotNull() | F.col("also").isNotNull())


def converted(entries: DataFrame, table: DataFrame, source: str) -> DataFrame:
    """(hans, hant, converted): each longer word, character by character through a table."""
    words = entries.where(F.char_length("hans") > 1).select("hans", "hant", F.when(F.size("reading") == F.char_length("hans"), F.col("reading")).alias("reading"))
    chars = words.select("hans", "hant", "reading", F.posexplode(F.split(source, "")).alias("at", "c"))
    named = table.select(F.col("source").alias("_c"), "to", "by_reading")
    key = F.regexp_replace(F.get("reading", F.col("at")), "(?<=.)(?<!^e)r([0-5]?)$", "$1")
    joined = chars.join(named, F.col("c") == F.col("_c"), "left").withColumn("out", F.coalesce(F.try_element_at("by_reading", F.coalesce(key, F.lit(""))), "to", "c"))
    return joined.groupBy("hans", "hant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]), "").alias("converted"))


def one_script_characters(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Characters only simplified words have, and characters only traditional ones have, among words whose forms differ."""
    plain = canonical_column(F.col("hans"))
    forms = F.filter(F.concat(F.array("hant"), F.coalesce("variants", F.array())), lambda f: (f != F.col("hans")) & (f != plain))
    apart = entries.select(plain.alias("hans"), forms.alias("forms")).where(F.size("forms") > 0)
    hans = apart.select(F.explode(F.split("hans", "")).alias("character")).distinct()
    hant = apart.select(F.explode("forms").alias("form")).select(F.explode(F.split(canonical_column(F.col("form")), "")).alias("character")).distinct()
    return hans.join(hant, "character", "left_anti"), hant.join(hans, "character", "left_anti")


def build(entries: DataFrame) -> dict[str, DataFrame]:
    """The six tables: to_hant, to_hans, hant_words, hans_words, hans_only, hant_only."""
    pairs = pairings(entries)
    to_hant, to_hans = conversions(pairs, "hans", "hant"), conversions(pairs, "hant", "hans")
    hans_only, hant_only = one_script_characters(entries)
    return {
        "to_hant": to_hant,
        "to_hans": to_hans,
        "hant_words": converted(entries, to_hant, "hans").where("converted <> hant").select(F.col("hans").alias("source"), F.col("hant").alias("to")),
        "hans_words": converted(entries, to_hans, "hant").where("converted <> hans").select(F.col("hant").alias("source"), F.col("hans").alias("to")),
        "hans_only": hans_only,
        "hant_only": hant_only,
    }


def collected(tables: dict[str, DataFrame]) -> ScriptTables:
    """The in-memory form for UDFs; a bounded reference table, like the dictionary."""
    character = lambda df: {r.source: Conversion(r.to, r.by_reading or {}, tuple(r.also or ())) for r in df.collect()}
    words = lambda df: {r.source: r.to for r in df.collect()}
    only = lambda df: frozenset(r.character for r in df.collect())
    return ScriptTables(character(tables["to_hant"]), character(tables["to_hans"]), words(tables["hant_words"]), words(tables["hans_words"]), only(tables["hans_only"]), only(tables["hant_only"]))


def written(tables: dict[str, DataFrame]) -> DataFrame:
    """The tables as tab-separated lines, tagged t, s, w, x, h and H."""
    characters = lambda tag, df: df.select(F.concat_ws("\t", F.lit(tag), "source", "to", F.coalesce(F.array_join(F.transform(F.map_entries("by_reading"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit("")), F.coalesce(F.array_join("also", ""), F.lit(""))).alias("line"))
    words = lambda tag, df: df.select(F.concat_ws("\t", F.lit(tag), "source", "to").alias("line"))
    only = lambda tag, df: df.select(F.concat_ws("\t", F.lit(tag), "character").alias("line"))
    parts = [characters("t", tables["to_hant"]), characters("s", tables["to_hans"]), words("w", tables["hant_words"]), words("x", tables["hans_words"]), only("h", tables["hans_only"]), only("H", tables["hant_only"])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.regexp_replace("line", "\t+$", "").alias("line"))


CURRENT_USES, CURRENT_SHARE = 10, 0.05


def character_counts(words: DataFrame, column: str) -> DataFrame:
    """(character, n): how often each character is written in the words."""
    return words.select(F.explode(F.split(F.col(column), "")).alias("character")).where("character <> ''").groupBy("character").agg(F.count("*").alias("n"))


def derived_glyphs(taiwan: DataFrame, hong_kong: DataFrame, simplified: DataFrame, traditional: DataFrame) -> DataFrame:
    """(kind, source, to) from regional variant tables (character, forms) and character counts of words in either script.

    canonical: a variant and Taiwan's form; hong_kong: Taiwan's form and Hong Kong's;
    excluded: variants that are characters in their own right, because simplified words use
    them or traditional ones do often. Where keys disagree the last by code point counts.
    """
    keys = taiwan.select("character").union(hong_kong.select("character")).distinct()
    rows = keys.join(taiwan.withColumnRenamed("forms", "tw"), "character", "left").join(hong_kong.withColumnRenamed("forms", "hk"), "character", "left")
    none = F.array().cast("array<string>")
    rows = rows.select("character", F.coalesce(F.get("tw", F.lit(0)), "character").alias("target"), F.coalesce(F.get("hk", F.lit(0)), "character").alias("regional"), F.array_distinct(F.concat(F.array("character"), F.coalesce("tw", none), F.coalesce("hk", none))).alias("spellings"))
    regional = rows.where("target <> regional").groupBy(F.col("target").alias("source")).agg(F.max_by("regional", "character").alias("to")).select(F.lit("hong_kong").alias("kind"), "source", "to")
    spelt = rows.select("character", "target", F.explode("spellings").alias("source")).where("source <> target").join(rows.select(F.col("target").alias("source")).distinct(), "source", "left_anti")
    uses = lambda df, key, name: df.select(F.col("character").alias(key), F.col("n").alias(name))
    counted = spelt.join(uses(simplified, "source", "hans"), "source", "left").join(uses(traditional, "source", "hant"), "source", "left").join(uses(traditional, "target", "settled"), "target", "left")
    often = (F.coalesce("hant", F.lit(0)) >= CURRENT_USES) & (F.coalesce("hant", F.lit(0)) > F.coalesce("settled", F.lit(0)) * CURRENT_SHARE)
    current = (F.coalesce("hans", F.lit(0)) > 0) | often
    kinds = counted.select("source", "target", "character", F.when(current, "excluded").otherwise("canonical").alias("kind"))
    return kinds.groupBy("kind", "source").agg(F.max_by("target", "character").alias("to")).unionByName(regional)


def glyph_differences(derived: DataFrame, kept: DataFrame) -> DataFrame:
    """(source, to, only_in): pairs that one of two glyph tables has and the other hasn't."""
    return derived.exceptAll(kept).withColumn("only_in", F.lit("derived")).unionByName(kept.exceptAll(derived).withColumn("only_in", F.lit("kept")))
