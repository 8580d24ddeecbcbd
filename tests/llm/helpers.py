"""Small documents with every awkward case, and columns whose names clash with the operators' own."""

import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("score", "spots", "starts", "label", "rep", "unit", "parts", "bucket", "component", "hash", "y", "value", "text_key", "found", "block", "n_tokens", "to", "key", "part", "keep")


def prose(seed: int, n: int, vocabulary: int = 500) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text): nulls, blanks, a very long text, copies, near copies, repeated ids and rows."""
    base, long = prose(1, 120), prose(2, 60_000, 50_000)
    edited = base.split()
    edited[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "ONE"),
        (9, "two words"), (10, long), (11, prose(3, 40) + "\n" + base), (12, prose(4, 200)), (12, prose(4, 200)),
        (13, "x" * 100_000), (14, "übers großen Straßen \U0001f600 tëxt\x0bwith\x0cblanks " + prose(5, 30)), (None, base), (-3, prose(6, 25)),
        (15, prose(7, 30) + " " + prose(7, 30)), (16, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"),
    ]


def table(spark, rows, clashing: bool = True, schema: str = "doc_id bigint, text string") -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    if clashing:
        for name in CLASHING:
            if name not in df.columns:
                df = df.withColumn(name, F.lit("clash"))
    return df


def documents(spark, rows=None) -> DataFrame:
    return table(spark, awkward() if rows is None else rows)


def first_texts(rows) -> dict[int, str]:
    """doc_id to the smallest text of its rows."""
    out: dict[int, str] = {}
    for doc_id, text in rows:
        if doc_id is not None:
            out[doc_id] = min(text or "", out.get(doc_id, text or ""))
    return out
