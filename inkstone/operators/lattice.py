"""The lattice as DataFrame operators: edges, rules' context, cut points, locks, paths.

runs: (run_id, text). Words are found by an equi-join of all substrings of 1 to 16
characters with the dictionary: its keys are a bounded reference table, so the substrings
stay where they are, and every later step groups by run. Costs are doubles added in the
kernel's order; ``ord`` carries the order in which edges are relaxed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.glyphs import canonical_column
from ..functions.numerals import QUANTITY
from ..plans.decoder import LONGEST, READING_CHARGE, UNKNOWN_COST


def substrings(runs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(run_id, start, end, text, key): every substring of up to ``longest`` characters."""
    at = runs.select("run_id", F.col("text").alias("run"), F.explode(F.sequence(F.lit(0), F.char_length("text") - 1)).alias("start")).where(F.char_length("run") > 0)
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("run") - F.col("start")))).alias("size")
    cut = at.select("run_id", "run", "start", size).select("run_id", "start", (F.col("start") + F.col("size")).alias("end"), F.substring("run", F.col("start") + 1, F.col("size")).alias("text"))
    return cut.withColumn("key", canonical_column(F.col("text")))


def edges(runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(run_id, start, end, ord, text, reading, cost, reading_cost, pos, proper, known)."""
    found = substrings(runs).join(dictionary.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    single = F.col("end") - F.col("start") == 1
    every = F.when(F.col("_key").isNull(), F.array(F.array().cast("array<string>"))).when(single, F.concat(F.array("reading"), F.transform(F.coalesce("alternates", F.array()), lambda x: F.split(x, " ")))).otherwise(F.array("reading"))
    rows = found.where(single | F.col("_key").isNotNull()).select("run_id", "start", "end", "text", "pos", "proper", F.col("_key").isNotNull().alias("known"), "cost", F.posexplode(every).alias("rank", "reading"))
    cost = F.when(F.col("known"), F.col("cost") + F.col("rank").cast("double")).otherwise(F.lit(float(UNKNOWN_COST)))
    order = Window.partitionBy("run_id").orderBy("start", F.col("end") - F.col("start") == 1, "end", "rank")
    return rows.select("run_id", "start", "end", (F.row_number().over(order) - 1).alias("ord"), "text", "reading", cost.alias("cost"), (cost + F.lit(float(READING_CHARGE))).alias("reading_cost"), F.coalesce("pos", F.lit("")).alias("pos"), F.coalesce("proper", F.lit(False)).alias("proper"), "known")


def cut_points(edges: DataFrame) -> DataFrame:
    """(run_id, at): positions that no edge passes over, both ends included."""
    steps = edges.select("run_id", F.explode(F.array(F.struct((F.col("start") + 1).alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("s")).select("run_id", "s.*")
    ends = edges.groupBy("run_id").agg(F.max("end").alias("n")).select("run_id", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("at"), F.lit(0).alias("step"))
    net = steps.unionByName(ends).groupBy("run_id", "at").agg(F.sum("step").alias("step"))
    over = Window.partitionBy("run_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return net.withColumn("spanning", F.sum("step").over(over)).where("spanning = 0").select("run_id", "at")


def units(edges: DataFrame) -> DataFrame:
    """(run_id, start, end, reading, cost, reading_cost, ord): a row a character where the reading has a syllable for each, else the span."""
    aligned = F.size("reading") == F.col("end") - F.col("start")
    apart = F.transform("reading", lambda s, k: F.struct((F.col("start") + k).alias("start"), (F.col("start") + k + 1).alias("end"), s.alias("reading")))
    whole = F.array(F.struct(F.col("start"), F.col("end"), F.array_join("reading", " ").alias("reading")))
    return edges.select("run_id", "ord", "cost", "reading_cost", F.explode(F.when(aligned, apart).otherwise(whole)).alias("u")).select("run_id", "ord", "u.start", "u.end", "u.reading", "cost", "reading_cost")


def locks(edges: DataFrame) -> DataFrame:
    """(run_id, at, claims, locked, start, end, reading): how many readings claim a position, and the one that holds it if all edges agree."""
    claim = units(edges).select("run_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("at"), "start", "end", "reading")
    at = claim.groupBy("run_id", "at").agg(F.count_distinct(F.struct("start", "end", "reading")).alias("claims"), F.min(F.struct("start", "end", "reading")).alias("u"))
    sole = F.col("claims") == 1
    span = Window.partitionBy("run_id", "u.start", "u.end")
    whole = F.min(sole.cast("int")).over(span) == 1
    covered = F.count("*").over(span) == F.col("u.end") - F.col("u.start")
    return at.select("run_id", "at", "claims", (sole & whole & covered).alias("locked"), "u.start", "u.end", "u.reading")


def shortest_paths(edges: DataFrame, cost: str = "cost") -> DataFrame:
    """(run_id, total, path): the cheapest path of each run as its edges' starts; a fold over the run's edges in order."""
    ordered = edges.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end", F.col(cost).alias("cost")))).alias("edges"), F.max("end").alias("n"))
    state = "map<int,struct<total:double,path:array<int>>>"
    begin = F.create_map(F.lit(0), F.struct(F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("path"))).cast(state)

    def relax(best, e):
        here = F.try_element_at(best, e["start"])
        rival = F.try_element_at(best, e["end"])
        total = here["total"] + e["cost"]
        better = here.isNotNull() & (rival.isNull() | (total < rival["total"]))
        arrived = F.create_map(e["end"], F.struct(total.alias("total"), F.concat(here["path"], F.array(e["start"])).alias("path"))).cast(state)
        return F.when(better, F.map_concat(F.map_filter(best, lambda k, _: k != e["end"]), arrived)).otherwise(best)

    best = ordered.select("run_id", "n", F.aggregate("edges", begin, relax).alias("best"))
    return best.select("run_id", F.try_element_at("best", F.col("n"))["total"].alias("total"), F.try_element_at("best", F.col("n"))["path"].alias("path"))


def greedy_words(runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(run_id, start, word): the longest key from each position on, unknown characters alone."""
    best = substrings(runs).join(dictionary.select(F.col("key").alias("_key")), F.col("key") == F.col("_key"), "left_semi").groupBy("run_id", "start").agg(F.max_by("text", "end").alias("word"))
    every = substrings(runs, 1).select("run_id", "start", F.col("text").alias("single")).join(best, ["run_id", "start"], "left")
    steps = every.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("start", F.coalesce("word", "single").alias("word")))).alias("steps"))

    def walk(acc, s):
        return F.when(s["start"] == acc["at"], F.struct((s["start"] + F.char_length(s["word"])).alias("at"), F.concat(acc["words"], F.array(s)).alias("words"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.slice("steps", F.lit(1), F.lit(0)).alias("words"))
    taken = F.aggregate("steps", start, walk, lambda acc: acc["words"])
    return steps.select("run_id", F.explode(taken).alias("w")).select("run_id", "w.start", "w.word")


def claim_costs(edges: DataFrame) -> DataFrame:
    """(run_id, start, end, reading, cost): the cheapest reading path through each claim, over the whole run."""
    grouped = edges.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end", F.col("reading_cost").alias("cost")))).alias("edges"), F.max("end").alias("n"))

    def sweep(arr, key, target, first):
        state = F.create_map(first, F.lit(0.0))

        def relax(best, e):
            here, rival = F.try_element_at(best, e[key]), F.try_element_at(best, e[target])
            total = here + e["cost"]
            return F.when(here.isNotNull() & (rival.isNull() | (total < rival)), F.map_concat(F.map_filter(best, lambda k, _: k != e[target]), F.create_map(e[target], total))).otherwise(best)

        return F.aggregate(arr, state, relax)

    backwards = F.reverse(F.array_sort(F.transform("edges", lambda e: F.struct(e["start"].alias("start"), e["ord"].alias("ord"), e["end"].alias("end"), e["cost"].alias("cost")))))
    swept = grouped.select("run_id", sweep(F.col("edges"), "start", "end", F.lit(0)).alias("ahead"), sweep(backwards, "end", "start", F.col("n")).alias("back"))
    through = units(edges).join(edges.select("run_id", "ord", F.col("start").alias("e_start"), F.col("end").alias("e_end")), ["run_id", "ord"]).join(swept, "run_id")
    total = F.try_element_at("ahead", F.col("e_start")) + F.col("reading_cost") + F.try_element_at("back", F.col("e_end"))
    return through.withColumn("through", total).groupBy("run_id", "start", "end", "reading").agg(F.min("through").alias("cost"))


def _nearest_words(runs: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The longest word of up to four characters that ends, and that begins, at each position: (run_id, at, tag, size)."""
    words = substrings(runs, 4).join(dictionary.select(F.col("key").alias("_key"), F.coalesce("pos", F.lit("")).alias("tag")), F.col("key") == F.col("_key"))
    sized = words.select("run_id", "start", "end", "tag", (F.col("end") - F.col("start")).alias("size"))

    def longest(at: str) -> DataFrame:
        best = sized.groupBy("run_id", F.col(at).alias("at")).agg(F.max_by(F.struct("tag", "size"), "size").alias("w"))
        return best.select("run_id", "at", "w.tag", "w.size")

    return longest("end"), longest("start")


def verdicts(edges: DataFrame, runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """edges and ``verdict``: force, forbid or null, by the first of the kernel's four rules that decides."""
    before, after = _nearest_words(runs, dictionary)
    near = lambda df, prefix: df.select(F.col("run_id").alias(f"{prefix}_run"), F.col("at").alias(f"{prefix}_at"), F.col("tag").alias(f"{prefix}_tag"), F.col("size").alias(f"{prefix}_size"))
    suffixed = dictionary.where((F.char_length("key") == 2) & F.col("key").endswith("儿") & F.element_at("reading", -1).rlike(".r[0-5]?$")).select(F.col("key").alias("er_key"))
    measures = dictionary.where((F.char_length("key") == 1) & (F.col("pos") == "q")).select(F.col("key").alias("q_key"))
    rows = edges.join(runs.select("run_id", F.col("text").alias("run")), "run_id")
    for df, prefix, place in ((before, "b", F.col("start")), (before, "t", F.col("end") - 1), (after, "a", F.col("end"))):
        rows = rows.join(near(df, prefix), (F.col("run_id") == F.col(f"{prefix}_run")) & (place == F.col(f"{prefix}_at")), "left").drop(f"{prefix}_run", f"{prefix}_at")
    rows = rows.join(suffixed, (F.col("start") > 0) & (F.col("text") == "儿") & (canonical_column(F.substring("run", F.col("start"), F.lit(2))) == F.col("er_key")), "left")
    rows = rows.join(measures, canonical_column(F.substring("text", 1, 1)) == F.col("q_key"), "left")

    tag = lambda c: F.coalesce(F.col(c), F.lit(""))
    aligned = F.size("reading") == F.col("end") - F.col("start")
    first, last = F.get("reading", F.lit(0)), F.try_element_at("reading", F.lit(-1))
    modal = (F.col("text") == "得") & (first == "dei3") & tag("b_tag").isin("r", "d", "t") & tag("a_tag").rlike("^[vpda]")
    follows = F.substring("run", F.col("end") + 1, F.lit(1))
    teaching = ~tag("t_tag").startswith("u") & (follows.isin("了", "过", "過", "着", "著", "得") | tag("a_tag").isin("r", "n", "nz", "nr", "nt", "ng"))
    single = F.col("text") == "教"
    taught = single & (first == "jiao1") & teaching
    untaught = ~single & (F.col("pos") == "") & F.col("text").endswith("教") & aligned & (last != "jiao1") & teaching
    quantity = F.char_length(F.regexp_extract(F.substring("run", F.lit(1), F.col("start")), f"([{''.join(sorted(QUANTITY))}]+)$", 1))
    ordinal = F.substring("run", F.col("start") - quantity, F.lit(1)) == "第"
    counted = (F.col("end") - F.col("start") > 1) & aligned & (quantity > 0) & ~((F.col("start") > quantity) & ordinal) & (F.coalesce("b_size", F.lit(0)) <= quantity) & F.col("q_key").isNotNull() & (F.col("pos") != "q")
    verdict = F.when(modal | taught, "force").when(untaught | F.col("er_key").isNotNull() | counted, "forbid")
    return rows.select(*edges.columns, verdict.alias("verdict"))


def ruled(edges: DataFrame, runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Edges without forbidden ones and rivals of forced ones; a run's edges are left as they are if no path would remain."""
    decided = verdicts(edges, runs, dictionary)
    span = Window.partitionBy("run_id", "start", "end")
    kept = decided.withColumn("rivalled", F.max((F.col("verdict") == "force").cast("int")).over(span) == 1).where((F.col("verdict") == "force") | (F.col("verdict").isNull() & ~F.coalesce("rivalled", F.lit(False))))
    ends = runs.select("run_id", F.char_length("text").alias("n"))
    whole = shortest_paths(kept).join(kept.groupBy("run_id").agg(F.max("end").alias("reached")), "run_id").join(ends, "run_id").where(F.col("total").isNotNull() & (F.col("reached") == F.col("n"))).select("run_id")
    unchanged = edges.join(whole, "run_id", "left_anti")
    return kept.join(whole, "run_id", "left_semi").select(*edges.columns).unionByName(unchanged)
