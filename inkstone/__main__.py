"""Command line: ``python -m inkstone COMMAND [TEXT ...]``; texts come from the arguments, a file that Spark reads, or standard input.

Every command is one DataFrame query over the texts; answers are printed a line each, or as
JSON documents with --json.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns, numerals, sandhi
from .functions.phonology import read_word, write
from .functions.romanise import SYSTEMS
from .operators import dictionary as dictionaries
from .operators import script_tables
from .plans import sample
from .plans.udf import Texts
from .sources import parsers

COMMANDS = "convert html slug script explain lookup syllable sandhi number transcribe info".split()


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkstone", description=__doc__.split("\n")[0])
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("texts", nargs="*")
    p.add_argument("--file", help="read texts from a file, one a line")
    p.add_argument("--keys", help="dictionary keys file; with --entries, instead of the sample dictionary")
    p.add_argument("--entries", help="dictionary entries file")
    p.add_argument("--json", action="store_true")
    p.add_argument("--greedy", action="store_true")
    p.add_argument("--locale", choices=("zh-CN", "zh-TW"), default="zh-CN")
    p.add_argument("--notation", choices=("marks", "numbers", "superscript", "none"), default="marks")
    p.add_argument("--apostrophe", choices=("always", "standard", "never"), default="always")
    p.add_argument("--capitals", choices=("auto", "proper", "none"), default="auto")
    p.add_argument("--punctuation", choices=("latin", "keep"), default="latin")
    p.add_argument("--numbers", choices=("read", "keep"))
    p.add_argument("--no-grouping", action="store_true")
    p.add_argument("--no-yi-bu", action="store_true")
    p.add_argument("--third-tone", action="store_true")
    p.add_argument("--system", choices=tuple(SYSTEMS))
    p.add_argument("--from", dest="source", choices=(*SYSTEMS, "Hans", "Hant"))
    p.add_argument("--to", dest="target", choices=("zh-Hans", "zh-Hant", "zh-Hant-TW", "zh-Hant-HK"), default="zh-Hans")
    p.add_argument("--style", choices=("cardinal", "digits", "percent"), default="cardinal")
    p.add_argument("--liang", choices=("always", "leading", "never"), default="always")
    p.add_argument("--counts", action="store_true")
    p.add_argument("--yao", action="store_true")
    p.add_argument("--separator", default="-")
    p.add_argument("--separate", action="store_true", help="slug: a part for each syllable")
    p.add_argument("--no-tones", action="store_true", help="slug: without tone digits")
    p.add_argument("--hash", type=int, nargs="?", const=4, default=0)
    p.add_argument("--max-length", type=int)
    p.add_argument("--fallback", default="")
    return p


def _said(text: Column, third: bool, yi_bu: bool) -> Column:
    """Sandhi over written pinyin; blanks part words."""

    def run(value: str) -> str | None:
        words = [read_word(w) for w in value.split()]
        if None in words:
            return None
        changed = sandhi.apply([s for w in words for s in w], yi_bu, third, [len(w) for w in words])
        return " ".join(write(s) for s in changed)

    return columns._udf(run, "string")(text)


def answers(spark: SparkSession, texts: DataFrame, a: argparse.Namespace) -> DataFrame:
    """(text, answer) or, for commands with several facts a text, (text, and the facts)."""
    t = F.col("text")
    if a.command in ("syllable", "sandhi", "number", "transcribe"):
        if a.command == "syllable":
            return texts.select("text", F.explode_outer(columns.read_word(t)).alias("syllable")).select("text", "syllable.*")
        if a.command == "sandhi":
            return texts.select("text", _said(t, a.third_tone, not a.no_yi_bu).alias("answer"))
        if a.command == "number":
            options = {"liang": a.liang, "counts": a.counts}
            hanzi = numerals.percent_column(t, **options) if a.style == "percent" else numerals.numeral_column(t, a.style, **options)
            return texts.select("text", hanzi.alias("answer"), F.array_join(numerals.pinyin_column(hanzi, a.notation, a.yao), " ").alias("pinyin"))
        if a.source and a.source != "pinyin":
            reader = "wade_giles_loose" if a.source == "wade_giles" else a.source
            found = texts.select("text", F.explode_outer(columns.read_candidates(t, reader)).alias("pinyin"))
        else:
            found = texts.select("text", t.alias("pinyin"))
        return found.select("text", "pinyin", *(columns.transcribe(F.col("pinyin"), s).alias(s) for s in SYSTEMS if s != "pinyin"))

    if a.keys and a.entries:
        frame = dictionaries.from_stored(parsers.stored_dictionary(spark, a.keys, a.entries))
        own, tables = dictionaries.collected(frame), None
    else:
        entries = dictionaries.sample_entries(spark)
        frame, own = dictionaries.dictionary_frame(entries), sample.dictionary()
        tables = script_tables.collected(script_tables.build(entries)) if a.command == "script" else None
    if a.command == "info":
        return frame.select(F.count("*").alias("keys"), F.count_if(F.char_length("key") == 1).alias("characters"))
    if a.command == "lookup":
        return dictionaries.lookup(texts, frame, "text").select("text", F.array_join("reading", " ").alias("answer"), F.array_join("taiwan", " ").alias("taiwan"), "pos", "proper", "alternates")
    texts_of = Texts(spark, own, tables)
    options = {"locale": a.locale, "notation": a.notation, "apostrophe": a.apostrophe, "capitals": a.capitals, "punctuation": a.punctuation, "grouping": not a.no_grouping, "yi_bu": not a.no_yi_bu, "third_tone": a.third_tone, "numbers": a.numbers or "read"}
    if a.command == "convert" and a.system and a.system != "pinyin":
        return texts.select("text", texts_of.system(t, a.system, **options).alias("answer"))
    if a.command == "convert":
        return texts.select("text", texts_of.pinyin(t, "greedy" if a.greedy else "lattice", **options).alias("answer"))
    if a.command == "html":
        return texts.select("text", texts_of.html(t, **options).alias("answer"))
    if a.command == "slug":
        return texts.select("text", texts_of.slug(t, tones="none" if a.no_tones else "numbers", separator=a.separator, syllables="separate" if a.separate else "join", hash=a.hash, max_length=a.max_length, fallback=a.fallback, locale=a.locale, numbers=a.numbers or "keep", yi_bu=not a.no_yi_bu, third_tone=a.third_tone).alias("answer"))
    if a.command == "script":
        source = a.source if a.source in ("Hans", "Hant") else None
        return texts.select("text", texts_of.script(t, a.target, source).alias("answer"), texts_of.script_choices(t, a.target, source).alias("choices"))
    pieces = texts.select("text", F.posexplode(texts_of.pieces(t, **options)).alias("at", "piece")).where("piece.syllable is not null")
    state = F.when(F.col("piece.locked"), "locked").when(F.col("piece.uncertain"), "uncertain").otherwise("likely")
    return pieces.select("text", "at", F.col("piece.text").alias("answer"), state.alias("state"), F.col("piece.alternatives").alias("alternatives"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("inkstone").getOrCreate()
    if a.file:
        texts = parsers.lines(spark, a.file).select("ord", F.col("value").alias("text"))
    else:
        own = a.texts or ([] if a.command == "info" else sys.stdin.read().removesuffix("\n").split("\n"))
        texts = spark.createDataFrame(list(enumerate(own)), "ord bigint, text string")
    found = answers(spark, texts.orderBy("ord").select("text"), a)
    shown = found.select(F.to_json(F.struct("*"))) if a.json or "answer" not in found.columns else found.select("answer")
    for row in shown.toLocalIterator():
        print("" if row[0] is None else row[0], file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
