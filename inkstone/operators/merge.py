"""Merging lexical sources into dictionary entries.

The sources meet by word in outer joins; what is left for Python is one word's own decision,
made on rows that hold everything known of it. The table of traditional forms by reading is
a tally of paired characters, bounded by the Han repertoire, and is broadcast.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.glyphs import canonical
from ..functions.phonology import NEUTRAL, Syllable, parse, strip_marks, unify_umlaut, write
from ..plans.decoder import BUCKETS, WORD_CHARGE
from ..plans.sample import bucket
from ..sources.parsers import PROPER_TAGS

SUFFIX_TOKEN, ROUNDS, SEGMENT_CHARGE = "r5", 4, 16
#: Words in 儿 without the suffix; asserted readings; compounds that take no reading from their parts.
NO_SUFFIX = frozenset("儿 女儿 儿子 儿女 儿童 儿科 儿孙 儿媳 儿媳妇 婴儿 幼儿 孤儿 男儿 健儿 宠儿 孩儿 娇儿 少儿 小儿 干儿 侄儿 胎儿 育儿 托儿 产儿 新生儿 混血儿 私生儿 白痴儿 健康儿 早产儿 试管婴儿".split())
ASSERTED = {"大夫": ("dai4", "fu5"), "一个": ("yi1", "ge4")}
NOT_COMPOSED = frozenset("相亲相爱 腹背相亲 洋为中用".split())
UNDERLYING = {"一": ("", "i", 1), "不": ("b", "u", 4)}
ENTRY = "hans string, hant string, variants array<string>, reading array<string>, taiwan array<string>, frequency bigint, pos string, proper boolean, boundaries array<int>, alternates array<string>, events array<string>"
_sign = lambda c: bool(c) and all(unicodedata.category(x)[0] in "PS" for x in c)


def with_suffix(s: Syllable) -> Syllable:
    """The syllable carrying the r suffix; a bare e or er takes it in."""
    return Syllable("", "er", s.tone) if s.sound() in (("", "e"), ("", "er")) else s._replace(erhua=True)


def aligned(word: str, tokens) -> list[tuple[str, Syllable | None]] | None:
    """A word's characters beside the tokens that read them; marks are unread, r5 joins its character to the one before; None if they don't fit."""
    out: list[tuple[str, Syllable | None]] = []
    at = 0
    for token in tokens:
        if token == SUFFIX_TOKEN:
            if not out or out[-1][1] is None or at >= len(word) or out[-1][1].erhua:
                return None
            out[-1] = (out[-1][0] + word[at], with_suffix(out[-1][1]))
            at += 1
            continue
        mark = _sign(token)
        while not mark and at < len(word) and _sign(word[at]):
            out.append((word[at], None))
            at += 1
        if at >= len(word):
            return None
        if mark:
            if not _sign(word[at]):
                return None
            out.append((word[at], None))
            at += 1
            continue
        s = parse(unify_umlaut(token))
        if s is None:
            return None
        tone = s.tone or NEUTRAL
        held = UNDERLYING.get(word[at])
        out.append((word[at], s.toned(held[2] if held and s.sound() == held[:2] else tone)))
        at += 1
    while at < len(word) and _sign(word[at]):
        out.append((word[at], None))
        at += 1
    return out if at == len(word) and any(s for _, s in out) else None


def syllables(pairs) -> list[Syllable] | None:
    return None if pairs is None else [s for _, s in pairs if s is not None]


def gap(a, b) -> float:
    """How far two readings are apart: any difference of sound outweighs all differences of tone."""
    if len(a) != len(b):
        return float("inf")
    sound = sum(x.sound() != y.sound() for x, y in zip(a, b, strict=True))
    tone = sum(x.sound() == y.sound() and x.tone != y.tone for x, y in zip(a, b, strict=True))
    return sound * (len(a) + 1) + tone


def toned_by_other_fields(readings, fields) -> list[str]:
    """Readings whose tone only the counted field leaves out, with the tone other fields write."""
    counted = next((f["readings"] for f in fields if f["field"] == "kHanyuPinlu"), [])
    marked = lambda r: strip_marks(r) != unicodedata.normalize("NFC", r)
    if not len(counted) or any(marked(r) for r in counted):
        return list(readings)
    others = [r for f in fields if f["field"] != "kHanyuPinlu" for r in f["readings"]]
    out = []
    for r in readings:
        same = [o for o in others if strip_marks(o) == r]
        out.append(r if marked(r) or not same or r in same else next((o for o in same if marked(o)), r))
    return out


def paired(hans: str, hant: str, pairs) -> list[tuple[str, str, str]]:
    """(simplified, traditional, reading key): characters side by side; the key is * where a syllable covers several."""
    if len(hans) != len(hant):
        return []
    groups = pairs if pairs is not None else [(c, None) for c in hans]
    out, at = [], 0
    for chars, s in groups:
        for c in chars:
            out.append((c, hant[at], sound_key(s) if len(chars) == 1 else "*"))
            at += 1
    return out


def sound_key(s: Syllable | None) -> str:
    return "*" if s is None else f"{s.initial}|{s.final}|{s.tone}"


class Traditional:
    """Traditional forms: as tallied for the reading, else for any, else the variant whose own readings fit best."""

    def __init__(self, tally: dict, variants: dict, readings: dict):
        self.tally, self.variants, self.readings = tally, variants, readings

    def _rank(self, form: str, s: Syllable | None) -> float:
        own = [parse(r) for r in self.readings.get(form, ())]
        if s is None:
            return 0 if own else float("inf")
        fits = [(k if o.tone == s.tone else len(own) + k) for k, o in enumerate(own) if o and o.sound() == s.sound()]
        exact = [k for k in fits if k < len(own)]
        return exact[0] if exact else min(fits, default=float("inf"))

    def character(self, c: str, s: Syllable | None) -> str:
        for key in (sound_key(s), "*"):
            if (c, key) in self.tally:
                return self.tally[(c, key)]
        best, rank = c, float("inf")
        for form in self.variants.get(c, ()):
            own = self._rank(form, s)
            if own < rank or own == rank and best == c:
                best, rank = form, own
        return best

    def word(self, pairs) -> str:
        return "".join(self.character(c, s if len(chars) == 1 or c == chars[0] else None) for chars, s in pairs for c in chars)


def decide(row: dict, traditional: Traditional) -> dict | None:
    """One word's entry from all that the sources say of it; None if nothing reads it. ``events`` names what was changed on the way."""
    word, senses, events = row["word"], row["senses"], []
    read = [aligned(word, s["readings"]) for s in senses]
    own = [syllables(x) for x in read if x is not None]
    everywhere = own + [x for x in (syllables(aligned(word, s["readings"])) for s in row["as_hant"]) if x is not None]
    single = len(word) == 1
    characters = [s for s in (x[0] for x in (syllables(aligned(word, [r])) for r in row["defaults"]) if x)]
    phrase = aligned(word, row["phrase"]) if row["phrase"] is not None else None
    pairs = phrase
    reading = syllables(phrase)
    if reading is None:
        if single and characters:
            reading, pairs = characters[:1], [(word, characters[0])]
        elif own:
            reading, pairs = own[0], aligned(word, senses[0]["readings"])
    if not reading:
        return None

    ends_er = len(word) > 1 and word[-1] in "儿兒"
    suffixed = ends_er and (any(r[-1].erhua for r in own) if own else word not in NO_SUFFIX)
    if suffixed:
        if len(reading) > 1 and reading[-1].sound() == ("", "er") and not reading[-2].erhua:
            reading = [*reading[:-2], with_suffix(reading[-2])]
            pairs = [*pairs[:-2], (pairs[-2][0] + pairs[-1][0], reading[-1])] if pairs and len(pairs) > 1 else pairs
            events.append("erhua")
    elif not any(s.erhua for s in reading):
        noted = next((aligned(word, s["readings"]) for s in senses if SUFFIX_TOKEN in s["readings"]), None)
        if noted is not None:
            reading, pairs = syllables(noted), noted
            events.append("erhua")

    if phrase is not None and own:
        near = min(own, key=lambda r: gap(reading, r))
        if gap(reading, near) < float("inf"):
            neutral = [s.toned(NEUTRAL) if s.sound() == o.sound() and o.tone == NEUTRAL else s for s, o in zip(reading, near, strict=True)]
            if neutral != reading:
                reading = neutral
                events.append("neutral")
    if word in ASSERTED:
        reading = [parse(t) for t in ASSERTED[word]]

    gaps = [float("inf") if x is None else gap(reading, syllables(x)) for x in read]
    least = min(gaps, default=float("inf"))
    fitting = [s for s, g in zip(senses, gaps, strict=True) if g == least] if least < float("inf") else senses[:1]
    hant = canonical(fitting[0]["traditional"]) if fitting else canonical(traditional.word(pairs or []))
    events += ["derived"] * (not fitting and hant != word) + ["pair"] * (hant != word)
    variants = [f for f in dict.fromkeys([*(canonical(s["traditional"]) for s in fitting), canonical(word)]) if f not in (hant, word)]

    noted = next((s for s in fitting if s["taiwan"] is not None), None)
    taiwan = None
    if noted is not None and not (noted["scope"] == "sense" and single):
        taiwan = syllables(aligned(word, noted["taiwan"]))
    elif single and row["taiwan"]:
        taiwan = syllables(aligned(word, [row["taiwan"]]))
    if taiwan == reading or taiwan in everywhere:
        taiwan = None

    tag = row["pos"] or ""
    named = any(s["proper"] for s in senses) if row["pos"] is None else tag in PROPER_TAGS and (not fitting or any(s["proper"] for s in fitting))
    events += ["veto"] * (tag in PROPER_TAGS and not named) + ["taiwan"] * (taiwan is not None)
    bounds = []
    if named and len(word) == len(reading):
        for s in senses:
            tokens = list(s["readings"])
            big = [t[:1] != t[:1].lower() for t in tokens]
            bounds = bounds or [k for k in range(1, len(tokens)) if big[k] and big[0]]
    others = [s for s in characters if single and [s] != reading]
    text = lambda r: [write(s, "numbers") for s in r]
    return {"hans": word, "hant": hant, "variants": variants, "reading": text(reading), "taiwan": text(taiwan) if taiwan else None, "frequency": int(row["frequency"] or 0), "pos": tag, "proper": bool(named), "boundaries": bounds, "alternates": text(others), "events": events}


def _plain(value):
    """Rows of Arrow structs as dictionaries and lists."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if hasattr(value, "tolist") and not isinstance(value, str):
        value = value.tolist()
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def traditional_tally(senses: DataFrame) -> DataFrame:
    """(hans, key, form): the form met most often for a character, by reading and (key '*') in all; of equal ones another than itself, then the first met."""

    def run(batches):
        for batch in batches:
            out = [(*p, int(o)) for o, hans, hant, tokens in zip(batch.ord, batch.simplified, batch.traditional, batch.readings, strict=True) for p in paired(hans, hant, aligned(hans, list(tokens)))]
            yield pd.DataFrame(out, columns=["hans", "hant", "key", "ord"])

    pairs = senses.select("ord", "simplified", "traditional", "readings").mapInPandas(run, "hans string, hant string, key string, ord bigint")
    every = pairs.where("key <> '*'").unionByName(pairs.withColumn("key", F.lit("*")))
    counts = every.groupBy("hans", "key", "hant").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.groupBy("hans", "key").agg(F.min_by("hant", F.struct(-F.col("n"), F.col("hans") == F.col("hant"), "first")).alias("form"))


def merge(unihan: DataFrame, variants: DataFrame, phrase: DataFrame, senses: DataFrame, frequency: DataFrame) -> DataFrame:
    """Entries (ENTRY, with the events that statistics count) of all words that some source reads; rejected words have a null hant.

    unihan: character, readings, fields, taiwan; variants: character, kind, variants; phrase:
    word, readings; senses: as sources.parsers.cedict gives them; frequency: word, frequency, pos.
    """
    one = F.struct("ord", "traditional", "readings", "proper", "taiwan", "scope")
    by_hans = senses.groupBy(F.col("simplified").alias("word")).agg(F.array_sort(F.collect_list(one)).alias("senses"))
    by_hant = senses.groupBy(F.col("traditional").alias("word")).agg(F.array_sort(F.collect_list(one)).alias("as_hant"))
    characters = unihan.select(F.col("character").alias("word"), F.col("readings").alias("found"), "fields", F.col("taiwan").alias("taiwan"))
    words = characters.select("word").union(phrase.select("word")).union(by_hans.select("word")).distinct()
    rows = words.join(by_hans, "word", "left").join(by_hant, "word", "left").join(phrase.withColumnRenamed("readings", "phrase"), "word", "left").join(characters, "word", "left").join(frequency, "word", "left")
    # bounded by the Han repertoire, whatever the sources' size
    tally = {(r.hans, r.key): r.form for r in traditional_tally(senses).collect()}
    forms = {r.character: list(r.variants) for r in variants.where("kind = 'traditional'").collect()}
    known = {r.character: list(r.readings) for r in unihan.select("character", "readings").collect()}
    held = senses.sparkSession.sparkContext.broadcast(Traditional(tally, forms, known))

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.to_dict("records"):
                row = {k: _plain(v) for k, v in raw.items()}
                row = {**row, "senses": row["senses"] or [], "as_hant": row["as_hant"] or [], "defaults": toned_by_other_fields(row["found"] or [], row["fields"] or []), "frequency": None if row["frequency"] is None or row["frequency"] != row["frequency"] else row["frequency"]}
                out.append(decide(row, held.value) or {"hans": row["word"], "events": ["rejected"]})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRY.split(", ")])

    return rows.mapInPandas(run, ENTRY)


def statistics(merged: DataFrame) -> DataFrame:
    """(event, words): how often each change was made."""
    return merged.select(F.explode("events").alias("event")).groupBy("event").agg(F.count("*").alias("words"))


# ---- Taiwan readings of compounds -----------------------------------------------------
def _segment(word: str, index: dict) -> list[tuple[str, tuple]] | None:
    """The cheapest division of a word into other known words; of equal ones the first found."""
    best: list = [(0.0, None)] + [(float("inf"), None)] * len(word)
    for start in range(len(word)):
        if best[start][0] == float("inf"):
            continue
        for end in range(start + 1, len(word) + 1):
            part = word[start:end]
            if part != word and part in index and (total := best[start][0] + index[part][0]) < best[end][0]:
                best[end] = (total, start)
    out, at = [], len(word)
    while at:
        if best[at][1] is None:
            return None
        out.append((word[best[at][1] : at], index[word[best[at][1] : at]]))
        at = best[at][1]
    return out[::-1]


def _composed(word: str, reading: list[str], index: dict, settled: dict) -> list[str] | None:
    parts = _segment(word, index)
    out, at, gave = [], 0, False
    for part, (_, hans, cn, tw) in parts or []:
        span = reading[at : at + len(part)]
        at += len(part)
        taiwan = settled.get(hans, tw)
        if taiwan is None or len(part) == 1:
            out += span
        elif list(cn) != span:
            return None
        else:
            out += taiwan
            gave = True
    return out if gave and out != reading else None


def compose_taiwan(entries: DataFrame) -> DataFrame:
    """Compounds of more than two characters inherit their parts' Taiwan readings, in at most four rounds.

    Compounds that hold no such part are left out by a semi-join first. The index of words
    is the dictionary itself, a bounded reference table.
    """
    spark = entries.sparkSession
    rows = entries.select("hans", "hant", "variants", "reading", "taiwan", "frequency").collect()
    most = max((r.frequency for r in rows), default=0)
    index: dict[str, tuple] = {}
    for r in rows:
        index[r.hans] = ((BUCKETS - 1 - bucket(r.frequency, most)) + WORD_CHARGE + SEGMENT_CHARGE, r.hans, list(r.reading), list(r.taiwan) if r.taiwan else None)
    for r in rows:
        for form in [r.hant, *(r.variants or [])]:
            index.setdefault(form, index[r.hans])
    held = spark.sparkContext.broadcast(index)

    marked = entries.where(F.col("taiwan").isNotNull() & (F.char_length("hans") > 1)).select(F.explode(F.array_distinct(F.concat(F.array("hans", "hant"), F.coalesce("variants", F.array())))).alias("part")).distinct()
    whole = entries.where(F.col("taiwan").isNull() & (F.char_length("hans") > 2) & (F.size("reading") == F.char_length("hans")) & ~F.col("hans").isin(*NOT_COMPOSED) & ~F.col("hant").isin(*NOT_COMPOSED))
    parts = whole.select("hans", F.explode(F.sequence(F.lit(1), F.char_length("hans"))).alias("a")).select("hans", "a", F.explode(F.sequence(F.lit(1), F.char_length("hans") - F.col("a") + 1)).alias("n")).select("hans", F.substring("hans", F.col("a"), F.col("n")).alias("part")).where("part <> hans")
    candidates = whole.join(parts.join(marked, "part", "left_semi").select("hans").distinct(), "hans", "left_semi").select("hans", "reading")

    settled: dict[str, list[str]] = {}
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(dict(settled))

        def run(batches, now=now):
            for batch in batches:
                found = [(h, _composed(h, list(r), held.value, now.value)) for h, r in zip(batch.hans, batch.reading, strict=True)]
                yield pd.DataFrame([(h, r) for h, r in found if r is not None and now.value.get(h) != r], columns=["hans", "taiwan"])

        changed = {r.hans: list(r.taiwan) for r in candidates.mapInPandas(run, "hans string, taiwan array<string>").collect()}
        if not changed:
            break
        settled |= changed
    if not settled:
        return entries
    given = spark.createDataFrame(list(settled.items()), "hans string, _taiwan array<string>")
    return entries.join(F.broadcast(given), "hans", "left").withColumn("taiwan", F.coalesce("taiwan", "_taiwan")).drop("_taiwan").select(*entries.columns)


# ---- gates ----------------------------------------------------------------------------
def inventory(entries: DataFrame) -> DataFrame:
    """(spelling, tone): every syllable that readings use."""
    tokens = entries.select(F.explode(F.concat("reading", F.coalesce("taiwan", F.array()), F.flatten(F.transform(F.coalesce("alternates", F.array()), lambda a: F.split(a, " "))))).alias("t"))
    return tokens.select(F.regexp_replace("t", "(?<=.)(?<!^e)r?[0-5]?$", "").alias("spelling"), F.regexp_extract("t", "([0-5])$", 1).try_cast("int").alias("tone")).distinct()


def unattested(entries: DataFrame, tones: DataFrame) -> DataFrame:
    """Syllables of readings that a table (spelling, tone) does not have."""
    return inventory(entries).join(tones, ["spelling", "tone"], "left_anti")


def failures(entries: DataFrame, readings: dict[str, str]) -> list[str]:
    """Build gates: words that must read as given (in marks), known syllables only, and one entry a word. Empty when all hold."""
    spark = entries.sparkSession
    wanted = spark.createDataFrame([(w, " ".join(write(parse(t), "numbers") for t in r.split())) for w, r in readings.items()], "hans string, wanted string") if readings else None
    out = []
    if wanted is not None:
        wrong = wanted.join(entries.select("hans", F.array_join("reading", " ").alias("reading")), "hans", "left").where(~F.col("wanted").eqNullSafe(F.col("reading")))
        out += [f"{r.hans}: {r.reading}, not {r.wanted}" for r in wrong.orderBy("hans").collect()]
    odd = [r.spelling for r in inventory(entries).select("spelling").distinct().collect() if parse(r.spelling) is None or not re.fullmatch("[a-zêü]+", r.spelling)]
    twice = [r.hans for r in entries.groupBy("hans").count().where("count > 1").collect()]
    return out + [f"unknown syllable {s}" for s in sorted(odd)] + [f"two entries of {w}" for w in sorted(twice)]


