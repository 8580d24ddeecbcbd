"""Secret scans with multipart credential linking, in DataFrame functions only.

*Base spans* are found by three patterns, each leftmost and non-overlapping; matches whose
value is too short are dropped after matching. A match's place follows from the text
between matches: ``split`` and ``regexp_extract_all`` cut the text alike, and running sums
of their lengths, taken in chunks so that texts with very many matches stay linear, are
the code-point offsets.

*Weak candidates* are parts that prove nothing alone: values of 40 base64 characters
(``part``; one may stand directly after a ``=``, as in ``NAME=value``) and service addresses (``endpoint``). They are reported only where parts that
complement each other co-occur in a scope. A scope is an access identifier's
neighbourhood, SCOPE code points to either side. Candidates and access identifiers of a
document meet in an interval join: both are posted under the SCOPE-wide bins they touch,
joined on (document, bin) and then on overlap. A part counts once it has an access
identifier in scope; an endpoint counts if one of its access identifiers also has a secret
(a part or an assignment) in scope. Only documents with both kinds enter the join.

Null texts are empty and give counts of 0. Rows that repeat a doc_id give a row each; a
null doc_id is kept. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

SCOPE = 400
CHUNK = 256
# Fixed by the contract: kinds in their listed order, patterns, least lengths.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
PART = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[^\s\"'<>]+"
KINDS = ("assign", "access", "hex", "part", "endpoint")
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def running(lengths: Column) -> Column:
    """Sums of all earlier entries, for each entry; linear for long arrays."""

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    n = F.size(lengths)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)))
    total = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
    lifted = F.zip_with(chunks, F.slice(sums(total), F.lit(1), F.size(total)), lambda c, base: F.transform(F.slice(sums(c), F.lit(1), F.size(c)), lambda x: x + base))
    return F.when(n > 0, F.flatten(lifted)).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, kind: str, pattern: str, least: int = 0, group: int = 0) -> Column:
    """The pattern's matches as (start, kind, end); those with a shorter group are dropped."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    gap = F.transform(between, lambda x: F.char_length(x).cast("bigint"))
    size = F.transform(found, lambda x: F.char_length(x).cast("bigint"))
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.char_length(x)) if group else size
    before = F.zip_with(running(F.zip_with(gap, size, lambda a, b: a + b)), gap, lambda a, b: a + b)
    whole = F.zip_with(F.arrays_zip(before.alias("start"), value.alias("value")), size, lambda s, n: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s["start"] + n).alias("end"), s["value"].alias("value")))
    kept = F.transform(F.filter(whole, lambda s: s["value"] >= least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array()).cast(_SPANS)


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(found: Column, *kinds: str) -> Column:
    wanted = [KINDS.index(k) for k in kinds]
    return F.filter(found, lambda s: reduce(lambda a, b: a | b, [s["kind"] == k for k in wanted]))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the text, base spans and weak candidates of each row."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = text.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        spans(F.col("text"), "assign", ASSIGN, 6, 2).alias("assign"),
        F.when(F.col("text").contains("AKIA"), spans(F.col("text"), "access", ACCESS, 20)).otherwise(F.array().cast(_SPANS)).alias("access"),
        spans(F.col("text"), "hex", HEX).alias("hex"),
        F.when(F.col("text").contains("AKIA"), F.concat(spans(F.col("text"), "part", PART), spans(F.col("text"), "endpoint", ENDPOINT))).otherwise(F.array().cast(_SPANS)).alias("weak"),
    )
    return found


def linked(found: DataFrame) -> DataFrame:
    """doc_id, text_key and the weak spans that complement an access identifier in scope."""
    both = found.where((F.size("access") > 0) & (F.size("weak") > 0)).select("doc_id", "text_key", "assign", "access", "weak").dropDuplicates(["doc_id", "text_key"])
    key = ["doc_id", "text_key"]

    def posted(spans: Column, prefix: str) -> DataFrame:
        one = both.select(*key, F.explode(spans).alias("s"))
        bins = F.sequence(F.floor((F.col("s.start") - SCOPE) / SCOPE), F.floor((F.col("s.end") + SCOPE) / SCOPE)) if prefix == "a" else F.sequence(F.floor(F.col("s.start") / SCOPE), F.floor((F.col("s.end") - 1) / SCOPE))
        return one.select(*(F.col(k).alias(f"{prefix}_{k}") for k in key), F.explode(bins).alias(f"{prefix}_bin"), *(F.col(f"s.{x}").alias(f"{prefix}_{x}") for x in ("start", "kind", "end")))

    ids = posted(F.col("access"), "a")
    parts = posted(F.concat("weak", "assign"), "w")
    met = ids.join(parts, [ids.a_doc_id.eqNullSafe(parts.w_doc_id), ids.a_text_key == parts.w_text_key, ids.a_bin == parts.w_bin, parts.w_start < ids.a_end + SCOPE, ids.a_start - SCOPE < parts.w_end, (parts.w_end <= ids.a_start) | (parts.w_start >= ids.a_end)])
    met = met.select(F.col("a_doc_id").alias("doc_id"), F.col("a_text_key").alias("text_key"), "a_start", "w_start", "w_kind", "w_end").distinct()
    secret = F.col("w_kind").isin(KINDS.index("part"), KINDS.index("assign"))
    scopes = met.groupBy(*key, "a_start").agg(F.max(secret).alias("complete"))
    scopes = scopes.select(F.col("doc_id").alias("s_doc_id"), F.col("text_key").alias("s_text_key"), F.col("a_start").alias("s_start"), "complete")
    whole = met.join(scopes, [F.col("doc_id").eqNullSafe(F.col("s_doc_id")), F.col("text_key") == F.col("s_text_key"), F.col("a_start") == F.col("s_start")])
    weak = whole.where("complete").where(F.col("w_kind").isin(KINDS.index("part"), KINDS.index("endpoint")))
    return weak.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(F.col("w_start").alias("start"), F.col("w_kind").alias("kind"), F.col("w_end").alias("end"))).cast(_SPANS).alias("extra"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_assign, n_access, n_hex, base_sha256, spans and found (the spans as structs) of each row."""
    found = cut(scanned(docs))
    extra = linked(found).select(F.col("doc_id").alias("x_doc_id"), F.col("text_key").alias("x_text_key"), "extra")
    out = found.join(extra, [found.doc_id.eqNullSafe(extra.x_doc_id), found.text_key == extra.x_text_key], "left")
    base = F.concat("assign", "access", "hex")
    every = F.concat(base, F.coalesce("extra", F.array().cast(_SPANS)))
    return out.select("doc_id", "text_key", F.size("assign").cast("bigint").alias("n_assign"), F.size("access").cast("bigint").alias("n_access"), F.size("hex").cast("bigint").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"), F.array_sort(every).alias("found"))


def masked(docs: DataFrame) -> DataFrame:
    """The documents, every span found replaced by ``[kind]`` (overlapping spans by the first one's); n_chars follows where there is such a column."""
    key = [F.col("doc_id").cast("bigint").eqNullSafe(F.col("m_doc_id")), F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("m_text_key")]
    hits = secrets(docs).where(F.size("found") > 0).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("m_doc_id"), F.col("text_key").alias("m_text_key"), F.col("found").alias("m_found"))
    joined = docs.join(hits, key, "left")
    names = F.array(*(F.lit(k) for k in KINDS))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("text"))
    whole = F.aggregate(
        "m_found",
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["text"]).otherwise(F.concat(acc["text"], F.substring(F.col("text"), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))).alias("text"),
        ),
        lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.char_length("text"))),
    )
    out = joined.withColumn("text", F.when(F.col("m_found").isNull(), F.col("text")).otherwise(whole))
    if "n_chars" in docs.columns:
        changed = F.col("m_found").isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
