"""Whole-text operators as Arrow UDFs; the dictionary is broadcast once and equal texts of a batch are decoded once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SYLLABLE, _struct
from ..functions.phonology import write
from . import convert as c
from .decoder import Dictionary

PIECE = f"struct<text:string,syllable:{SYLLABLE.simpleString()},locked:boolean,uncertain:boolean,alternatives:array<struct<start:int,end:int,reading:string,cost:double>>>"
CHOICE = "struct<source:string,to:string,evidence:string,alternatives:array<string>>"


class Texts:
    """Operators over texts, for one dictionary. Null texts give nulls.

    Columns are marked as not deterministic, though they are: otherwise a filter on one (an
    explode brings its own) is moved below what made texts distinct, and decodes every row.
    """

    def __init__(self, spark: SparkSession, dictionary: Dictionary, tables: c.ScriptTables | None = None):
        self._held = spark.sparkContext.broadcast((dictionary, tables or c.ScriptTables()))

    def _column(self, text: Column, kind: str, function: Callable) -> Column:
        held = self._held

        @F.pandas_udf(kind)
        def run(values: pd.Series) -> pd.Series:
            known: dict = {}
            out = []
            for v in values:
                if v is not None and v not in known:
                    known[v] = function(*held.value, v)
                out.append(None if v is None else known[v])
            return pd.Series(out, dtype=object)

        return run.asNondeterministic()(text)

    def pinyin(self, text: Column, method: str = "lattice", **options) -> Column:
        own = c.Options(**options)
        return self._column(text, "string", lambda d, _, v: c.to_pinyin(d, v, own, method))

    def pieces(self, text: Column, method: str = "scored", **options) -> Column:
        """An array of pieces: explode it for a row each."""
        own = c.Options(**options)

        def one(x: c.Piece) -> dict:
            sure = x.confidence
            others = [] if sure is None else [{"start": u.start, "end": u.end, "reading": " ".join(write(s) for s in u.reading), "cost": float(cost)} for u, cost in sure.alternatives]
            return {"text": x.text, "syllable": _struct(x.syllable), "locked": sure and sure.locked, "uncertain": sure and sure.uncertain(), "alternatives": others}

        return self._column(text, f"array<{PIECE}>", lambda d, _, v: [one(x) for x in c.pieces(d, v, own, method)])

    def html(self, text: Column, tone_classes: bool = True, mark_uncertain: bool = True, lang: bool = True, **options) -> Column:
        own = c.Options(**options)
        return self._column(text, "string", lambda d, _, v: c.to_html(c.pieces(d, v, own, "scored"), own, tone_classes, mark_uncertain, lang))

    def system(self, text: Column, system: str, capitals: bool = True, system_options: dict | None = None, **options) -> Column:
        own = c.Options(**options)
        return self._column(text, "string", lambda d, _, v: c.to_system(c.pieces(d, v, own), system, capitals, **(system_options or {})))

    def slug(self, text: Column, **options) -> Column:
        own = c.SlugOptions(**options)
        return self._column(text, "string", lambda d, _, v: c.to_slug(d, v, own))

    def script(self, text: Column, target: str = "zh-Hans", source: str | None = None) -> Column:
        return self._column(text, "string", lambda d, t, v: c.to_script(d, t, v, target, source)[0])

    def script_choices(self, text: Column, target: str = "zh-Hans", source: str | None = None) -> Column:
        return self._column(text, f"array<{CHOICE}>", lambda d, t, v: [{**x._asdict(), "alternatives": list(x.alternatives)} for x in c.to_script(d, t, v, target, source)[1]])
