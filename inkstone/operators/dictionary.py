"""Dictionaries as DataFrames: keys, costs, lookups, tiers, and the stored text format.

Columns of a dictionary: key, reading (array of syllables in numbers notation), taiwan, pos,
proper, boundaries, bucket, cost, alternates (readings joined by blanks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.glyphs import canonical_column
from ..functions.phonology import parse, write
from ..plans import sample
from ..plans.decoder import BUCKETS, WORD_CHARGE, Dictionary, Entry
from ..sources import parsers

DICTIONARY_DDL = "key string, reading array<string>, taiwan array<string>, pos string, proper boolean, boundaries array<int>, bucket int, alternates array<string>"
ENTRY_DDL = "hans string, hant string, variants array<string>, reading array<string>, taiwan array<string>, frequency bigint, pos string, proper boolean, boundaries array<int>, alternates array<string>"
STANDARD_WORDS = 50_000


def cost(bucket: Column) -> Column:
    """What an edge of the word costs: added in this order, so that doubles are equal everywhere."""
    return (F.lit(float(BUCKETS - 1)) - bucket.cast("double")) + F.lit(WORD_CHARGE)


def numbers(reading) -> list[str]:
    return [write(s, "numbers") for s in reading]


def sample_entries(spark: SparkSession) -> DataFrame:
    """The hand-entered entries."""
    rows = [(r["hans"], r["hant"], [], numbers(sample.read(r["cn"])), numbers(sample.read(r["tw"])) if r["tw"] else None, r["frequency"], r["pos"], r["proper"], [], [" ".join(numbers(sample.read(a))) for a in r["alternates"]]) for r in sample.rows()]
    return spark.createDataFrame(rows, ENTRY_DDL)


def claim_keys(entries: DataFrame) -> DataFrame:
    """Key to entry: a headword is its most frequent entry's; another form is an alias that displaces no headword."""
    heads = entries.select(F.col("hans").alias("key"), F.lit(0).alias("alias"), "*")
    forms = F.array_distinct(F.concat(F.array("hant"), F.coalesce("variants", F.array())))
    aliases = entries.select(F.explode(forms).alias("key"), F.lit(1).alias("alias"), "*").where("key <> hans")
    order = Window.partitionBy("key").orderBy("alias", F.desc("frequency"), "hans")
    return heads.unionByName(aliases).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "alias")


def frequency_buckets(df: DataFrame, frequency: str = "frequency") -> DataFrame:
    """df and ``bucket``, 0 to 15 by the logarithm of the frequency; negative ones count as 0."""
    most = df.agg(F.greatest(F.max(frequency), F.lit(0)).alias("most"))
    own = F.greatest(F.col(frequency), F.lit(0)).cast("double")
    scaled = F.floor(F.log1p(own) * (F.lit(float(BUCKETS - 1)) / F.log1p(F.col("most").cast("double"))) + 0.5)
    return df.join(F.broadcast(most)).withColumn("bucket", F.when(F.col("most") <= 0, 0).otherwise(F.least(scaled, F.lit(BUCKETS - 1))).cast("int")).drop("most")


def dictionary_frame(entries: DataFrame) -> DataFrame:
    """The decoder's dictionary of a set of entries."""
    claimed = frequency_buckets(claim_keys(entries))
    return claimed.select("key", "reading", "taiwan", "pos", "proper", "boundaries", "bucket", "alternates").withColumn("cost", cost(F.col("bucket")))


def collected(dictionary: DataFrame, idioms=()) -> Dictionary:
    """The in-memory form that UDFs broadcast: a dictionary is a bounded reference table (the largest known has under a million keys)."""
    one = lambda tokens: tuple(parse(t) for t in tokens)
    rows = dictionary.select("key", "reading", "taiwan", "pos", "proper", "boundaries", "bucket", "alternates").collect()
    return Dictionary((Entry(r.key, one(r.reading), one(r.taiwan) if r.taiwan else None, r.pos or "", bool(r.proper), tuple(r.boundaries or ()), r.bucket, tuple(one(a.split(" ")) for a in r.alternates or ())) for r in rows), idioms)


def lookup(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """words and their entries, found by canonical form; nulls where unknown."""
    return words.join(dictionary, canonical_column(F.col(word)) == F.col("key"), "left")


def readings(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """A row for each reading of a character, the likeliest first: word, rank, reading."""
    every = F.concat(F.array(F.array_join("reading", " ")), F.coalesce("alternates", F.array()))
    return lookup(words, dictionary, word).where("key is not null").select(word, F.posexplode(every).alias("rank", "reading"))


def characters_in_use(entries: DataFrame) -> DataFrame:
    """Distinct characters of longer words in either script, and characters that occur by themselves."""
    longer = entries.where(F.char_length("hans") > 1).select(F.explode(F.concat(F.split("hans", ""), F.split("hant", ""))).alias("character"))
    return longer.union(entries.where((F.char_length("hans") == 1) & (F.col("frequency") > 0)).select("hans")).distinct()


def tier(entries: DataFrame, name: str = "full", words: int = STANDARD_WORDS) -> DataFrame:
    """core: characters in use; standard: those and the most frequent words; full: everything."""
    if name == "full":
        return entries
    single = F.char_length("hans") == 1
    core = entries.where(single).join(characters_in_use(entries), F.col("hans") == F.col("character"), "left_semi")
    if name == "core":
        return core
    return core.unionByName(entries.where(~single).orderBy(F.desc("frequency"), "hans").limit(words))


def character_defaults(claimed: DataFrame) -> DataFrame:
    return claimed.where(F.char_length("key") == 1).select(F.col("key").alias("character"), F.array_join("reading", " ").alias("default"))


def derivable(claimed: DataFrame) -> DataFrame:
    """claimed and whether a word's reading is its characters' defaults in order."""
    parts = claimed.where(F.char_length("key") > 1).select("key", F.posexplode(F.split("key", "")).alias("at", "character"))
    read = parts.join(character_defaults(claimed), "character", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "default"))).alias("d"), F.count("default").alias("known"))
    joined = read.select("key", F.when(F.col("known") == F.size("d"), F.array_join(F.transform("d", lambda x: x["default"]), " ")).alias("derived"))
    return claimed.join(joined, "key", "left").withColumn("derivable", F.coalesce(F.col("derived") == F.array_join("reading", " "), F.lit(False))).drop("derived")


def stored_lines(entries: DataFrame) -> DataFrame:
    """The stored text format: key, a line of tab-separated reading, Taiwan reading, tag, flags and alternates without trailing empties, and bucket."""
    rows = derivable(frequency_buckets(claim_keys(entries)))
    flags = F.when(F.col("proper"), F.concat(F.lit("p"), F.coalesce(F.array_join(F.transform("boundaries", lambda x: x.cast("string")), "."), F.lit("")))).otherwise("")
    columns = F.concat_ws("\t", F.when(F.col("derivable"), "").otherwise(F.array_join("reading", " ")), F.coalesce(F.array_join("taiwan", " "), F.lit("")), F.coalesce("pos", F.lit("")), flags, F.coalesce(F.array_join("alternates", ","), F.lit("")))
    return rows.select("key", F.regexp_replace(columns, "\t+$", "").alias("line"), "bucket")


def packed(buckets: Column) -> Column:
    """An array of buckets in bytes, two a byte, the first in the high half."""
    digits = F.array_join(F.transform(buckets, lambda b: F.hex(b.cast("bigint"))), "")
    return F.unhex(F.when(F.size(buckets) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def write_stored(entries: DataFrame, folder: str, tier_name: str) -> None:
    """The three files of a tier: keys, lines and packed buckets, in the order of the keys' UTF-16 units.

    A dictionary is a bounded reference table, so its files are one each and written by the driver.
    """
    spark = entries.sparkSession
    rows = stored_lines(entries).select(F.struct(F.encode("key", "UTF-16BE").alias("order"), "key", "line", "bucket").alias("r"))
    whole = rows.agg(F.array_sort(F.collect_list("r")).alias("rows"))
    column = lambda name: F.transform("rows", lambda r: r[name])
    text = lambda name: F.encode(F.concat(F.array_join(column(name), "\n"), F.lit("\n")), "UTF-8")
    parts = whole.select(text("key").alias("keys"), text("line").alias("entries"), packed(column("bucket")).alias("frequencies")).first()
    for part, name in parsers.tier_files(tier_name).items():
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
        try:
            out.write(bytearray(parts[part]))
        finally:
            out.close()


def from_stored(lines: DataFrame) -> DataFrame:
    """A dictionary from stored lines (key, line, optional bucket); derived readings are rebuilt from characters."""
    cells = F.split("line", "\t", -1)
    cell = lambda k: F.coalesce(F.get(cells, F.lit(k)), F.lit(""))
    bucket = F.coalesce("bucket", F.lit(0)) if "bucket" in lines.columns else F.lit(0)
    rows = lines.select("key", cell(0).alias("stored"), cell(1).alias("tw"), cell(2).alias("pos"), cell(3).alias("flags"), cell(4).alias("others"), bucket.alias("bucket"))
    defaults = rows.where((F.char_length("key") == 1) & (F.col("stored") != "")).select(F.col("key").alias("character"), F.col("stored").alias("default"))
    parts = rows.where("stored = ''").select("key", F.posexplode(F.split("key", "")).alias("at", "character")).join(defaults, "character", "left")
    built = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "default"))).alias("d")).select("key", F.array_join(F.transform("d", lambda x: x["default"]), " ").alias("built"))
    whole = rows.join(built, "key", "left")
    split = lambda c: F.split(c, " ")
    return whole.select(
        "key",
        split(F.when(F.col("stored") != "", F.col("stored")).otherwise(F.col("built"))).alias("reading"),
        F.when(F.col("tw") != "", split(F.col("tw"))).alias("taiwan"),
        "pos",
        F.col("flags").startswith("p").alias("proper"),
        F.when(F.col("flags").rlike("^p[0-9]"), F.transform(F.split(F.substring("flags", 2, 1000), "[.]"), lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>")).alias("boundaries"),
        F.col("bucket").cast("int").alias("bucket"),
        F.when(F.col("others") != "", F.split("others", ",")).otherwise(F.array().cast("array<string>")).alias("alternates"),
    ).withColumn("cost", cost(F.col("bucket")))


def round_trip_failures(entries: DataFrame) -> DataFrame:
    """Keys whose reading does not come back from the stored format; empty when it is sound."""
    back = from_stored(stored_lines(entries)).select("key", F.array_join("reading", " ").alias("reading"))
    return claim_keys(entries).select("key", F.array_join("reading", " ").alias("reading")).exceptAll(back)
