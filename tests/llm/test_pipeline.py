import inspect
import os
import random
import re

import numpy as np

import corpus_pipeline as p
from inkstone.llm import minhash_dedup, mixing, quality_votes, secret_linking, template_decontamination
from inkstone.llm.textblocks import Block

from .helpers import CLASHING, awkward, prose, table
from .test_minhash_dedup import brute

LABELS = "doc_id bigint, quality int, toxic int"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    """Clean documents, junk, near copies, a leak and a secret, and what should become of each."""
    texts = {k: prose(1000 + k, 60, 5000).capitalize() + "." for k in range(120)}
    labels = [(k, 1, 0) for k in range(60)]
    for k in range(200, 240):
        texts[k] = " | ".join(w + "%%%" for w in prose(k, 50, 5000).split())
        labels.append((k, 0, 0))
    texts[300] = texts[3]
    texts[301] = " ".join([*texts[4].split()[:-1], "changed"])
    leak = prose(9999, 40, 5000)
    texts[302] = prose(5000, 30, 5000).capitalize() + " " + leak + ". " + prose(5001, 30, 5000)
    texts[303] = prose(5002, 60, 5000).capitalize() + " password=hunter22 end."
    docs = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in texts.items()]
    return docs, labels, [(1, leak)]


def test_each_stage_takes_effect(spark, tmp_path):
    folder = str(tmp_path)
    docs, labels, items = corpus()
    write(spark, folder, docs, labels, items)
    kept, frames = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in p.STAGES:
        out = stage(spark, kept, folder)
        if name != p.STAGES[-1][0]:
            assert out.columns == kept.columns
        out.write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        frames[name] = {r.doc_id: r for r in kept.collect()}
    clean = {k for k in range(120)}
    assert set(frames["quality_classifier"]) == clean | {300, 301, 302, 303}
    assert set(frames["near_dedup"]) == clean | {302, 303}
    assert set(frames["decontamination"]) == clean | {303}
    assert frames["secret_scan"][303].text.endswith("[assign] end.") and frames["secret_scan"][303].n_chars == len(frames["secret_scan"][303].text)
    assert all(frames["secret_scan"][k].text == frames["near_dedup"][k].text for k in clean)
    assert len(frames["mixing"]) > 110


def test_run_is_the_stages_in_order(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, *corpus())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/x{k}")
        docs = spark.read.parquet(f"{folder}/x{k}")
    assert sorted(map(tuple, p.run(spark, folder).collect())) == sorted(map(tuple, docs.collect()))


def test_awkward_documents_pass_every_stage(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(d, t, None, None if d == 3 else "s", None) for d, t in awkward()]
    write(spark, folder, rows, corpus()[1], [(1, None), (2, "")])
    out = p.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= {d for d, _ in awkward()}


def test_repeated_and_missing_ids_at_near_dedup_and_decontamination(spark, tmp_path):
    texts = [prose(7000 + k, 40, 5000) for k in range(12)]
    judged = min(texts[:6], key=lambda t: minhash_dedup.fingerprint(minhash_dedup.shingle_sets(block(t))[0]))
    rows = [(1, t, "en", "s", k) for k, t in enumerate(texts[:6])]
    rows += [(2, texts[6], "en", "s", 0), (3, texts[6], "en", "s", 0), (4, None, "en", "s", 0), (4, texts[7], "en", "s", 1)]
    rows += [(None, texts[8], "en", "s", 0), (None, texts[8], "en", "s", 0), (None, texts[9], "en", "s", 0), (None, None, "en", "s", 0)]
    want = {(1, judged), (2, texts[6]), (4, None), (None, texts[8]), (None, texts[9]), (None, None)}
    for order in (rows, rows[::-1]):
        out = p.near_dedup_stage(spark, spark.createDataFrame(order, DOCS).repartition(3), str(tmp_path))
        found = [(r.doc_id, r.text) for r in out.collect()]
        assert out.columns == [x.split()[0] for x in DOCS.split(", ")]
        assert set(found) == want and len(found) == len(want) + 1
    write(spark, str(tmp_path), rows, [], [(1, texts[9]), (2, judged)])
    left = p.decontamination_stage(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert {r.text for r in left if r.doc_id is None} == {texts[8], None} and len(left) == 14 - 6 - 1


def block(text):
    buf = np.frombuffer(text.encode(), np.uint8)
    return Block(0, buf, np.array([0, len(buf)]), lower=True)


def letters(r, n, vocabulary):
    return [r.choice(vocabulary) for _ in range(n)]


def test_run_against_brute_force(spark, tmp_path):
    """Near copies, leaks and secrets found by plain loops; what they leave, mixed, is what the pipeline returns."""
    r = random.Random(77)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9))) for _ in range(2000)]
    base = {k: letters(r, r.randrange(40, 90), vocabulary) for k in range(70)}
    for k in range(100, 130):  # near copies of near copies
        words = list(r.choice(list(base.values())))
        words[r.randrange(len(words))] = r.choice(vocabulary)
        base[k] = words
    items = [(k, " ".join(letters(r, 25, vocabulary))) for k in range(4)]
    for k in range(200, 212):  # whole items, and parts of them
        item = items[k % 4][1].split()
        base[k] = letters(r, 20, vocabulary) + item[: 25 if k % 3 else 18] + letters(r, 20, vocabulary)
    texts = {k: " ".join(w) + "." for k, w in base.items()}
    for k in range(0, 70, 9):
        texts[k] += f" password={r.randrange(10**8):08d} AKIA{r.randrange(10**16):016d}"
    docs = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in texts.items()]
    labels = [(k, 1, 0) for k in range(0, 130, 2)] + [(k, 0, 0) for k in range(300, 330)]
    junk = [(k, " | ".join(w + "%%%" for w in letters(r, 50, vocabulary)), "en", "s0", 0) for k in range(300, 340)]
    write(spark, str(tmp_path), docs + junk, labels, items)

    kept = {d for d, (_, _, stays) in brute([(k, t) for k, t in texts.items()]).items() if stays}
    windows = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    clean = lambda t: [x for x in (re.sub("[^a-z0-9]", "", w.lower()) for w in t.split()) if x]
    leaks = {d for d in kept for _, item in items if len(windows(clean(item)) & windows(clean(texts[d]))) >= 0.8 * len(windows(clean(item)))}
    assert leaks and len(kept) < len(texts) - 10
    masked = {d: re.sub(r"AKIA[0-9]{16}", "[access]", re.sub(r"password=[0-9]{8}", "[assign]", texts[d])) for d in kept - leaks}
    expected = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t)) for d, t in masked.items()], DOCS)
    found = sorted(map(tuple, p.run(spark, str(tmp_path)).collect()))
    assert found == sorted(map(tuple, mixing.mixture(expected).collect())) and len(found) > 60


def test_clashing_columns_and_repeated_ids_survive_every_stage(spark, tmp_path):
    folder = str(tmp_path)
    docs, labels, items = corpus()
    docs += [(5, prose(31, 60, 5000).capitalize() + ".", "en", "s", k) for k in range(2)]  # repeats doc_id 5 with another text
    write(spark, folder, [], labels, items)
    table(spark, docs, schema=DOCS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    names = [x for x in CLASHING if x in kept.columns]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, folder)
        assert out.schema == kept.schema
        out.write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        assert {tuple(r[n] for n in names) for r in kept.collect()} == {("clash",) * len(names)}
    assert kept.where("doc_id = 5").count() == 1
    assert p.run(spark, folder).count() > 100


def test_earlier_stages_are_removed(spark, tmp_path):
    write(spark, str(tmp_path), *corpus())
    out = p.run(spark, str(tmp_path))
    last = os.path.dirname(next(iter(out.inputFiles())).removeprefix("file:"))
    assert os.listdir(os.path.dirname(last)) == [p.STAGES[-1][0]]


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert p.run(spark, str(tmp_path)).collect() == []


def test_stages_are_the_dealt_operators():
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "secret_scan", "mixing"]
    assert p.ORACLE_SQL is None
    used = {inspect.getmodule(x) for x in (p.scored, p.near_duplicates, p.contamination, p.masked, p.mixture)}
    assert used == {quality_votes, minhash_dedup, template_decontamination, secret_linking, mixing}
    assert table is not None
