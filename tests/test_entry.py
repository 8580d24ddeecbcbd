import collections
import importlib
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(entry.engine.queries())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query_matches_its_sql(spark, name):
    df = entry.engine.queries()[name](spark, TINY)
    names = sorted(df.columns)
    rows = sorted(repr([round(r[c], 4) if isinstance(r[c], float) else r[c] for c in names]) for r in df.collect())
    assert rows
    sql = entry.oracles.oracle_sql().get(name)
    if sql is None:
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    cursor = db.execute(sql)
    at = [[d[0] for d in cursor.description].index(c) for c in names]
    assert len(cursor.description) == len(names)
    wanted = [[r[i] for i in at] for r in cursor.fetchall()]
    assert rows == sorted(repr([round(float(v), 4) if isinstance(v, float) else v for v in r]) for r in wanted)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_library_stands_without_the_training_data_part(monkeypatch):
    real = importlib.import_module

    def without(name, *a):
        if name.split(".")[:2] == ["inkstone", "llm"] or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    assert sorted(entry.queries()) == OWN
    assert set(entry.oracle_sql()) <= set(OWN)


def test_a_text_is_decoded_once(spark):
    plan = entry.engine.queries()["convert_pieces"](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan)) == 1
    below = plan[plan.index("ArrowEvalPython") :]
    assert re.search("Aggregate|Deduplicate|Distinct", below)  # made distinct before


DECODING = "convert convert_greedy convert_taiwan convert_pieces convert_html convert_wade_giles convert_bopomofo script_to_hant script_choices slug_hash".split()


def _decoded_below(df):
    """The plan below the only decoding of it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan)) == 1
    return plan[plan.index("ArrowEvalPython") :]


@pytest.mark.parametrize("name", DECODING)
def test_texts_are_made_distinct_before_they_are_moved_and_decoded(spark, name):
    query = entry.engine.queries()[name](spark, TINY)
    assert re.search(r"RepartitionByExpression.*\n(.*Project.*\n)?\W*Aggregate", _decoded_below(query))
    assert "REPARTITION_BY_NUM" in query._jdf.queryExecution().executedPlan().toString()  # spread, whatever their bytes


def test_a_filter_on_what_is_decoded_decodes_nothing_again(spark):
    decoded = entry.engine._decoded(spark, TINY, lambda t, c: t.pinyin(c), "pinyin")
    assert "Aggregate" in _decoded_below(decoded.where("length(pinyin) > 12"))


def test_script_choices_counts_every_order(spark):
    from inkstone.plans import convert

    query = entry.engine.queries()["script_choices"](spark, TINY)
    assert "Join" not in query._jdf.queryExecution().optimizedPlan().toString()
    own = entry.engine
    tables = own.script_tables.collected(own.script_tables.build(own.dictionaries.sample_entries(spark)))
    dictionary, counts = own.sample.dictionary(), collections.Counter()
    for r in own._texts(spark, TINY).collect():
        counts.update(x.evidence for x in convert.to_script(dictionary, tables, r.text + "2个。", "zh-Hant")[1])
    assert {r.evidence: r.n for r in query.collect()} == counts


def test_nothing_imports_the_training_data_part():
    root = Path(entry.__file__).parent
    files = [f for f in (root / "inkstone").rglob("*.py") if "llm" not in f.relative_to(root).parts]
    assert files
    for f in files:
        assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f
