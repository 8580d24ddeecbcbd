import random

import numpy as np
import pyarrow as pa
import pytest

from inkstone.llm import quality_votes, toxicity_kernel
from inkstone.llm.textblocks import Block

from .helpers import documents, prose, table

INSULTS = ["grumblor", "snivelet", "wretchok"]


def labelled(n=260):
    r = random.Random(3)
    docs, labels = [], []
    for k in range(n):
        bad, toxic = r.random() < 0.4, r.random() < 0.4
        words = [f"{''.join(r.choice('aeioulnrst') for _ in range(r.randrange(2, 8)))}" for _ in range(r.randrange(20, 60))]
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(INSULTS))
        text = " | ".join(w + "%%%" for w in words) if bad else " ".join(words).capitalize() + "."
        docs.append((k, text))
        labels.append((k, 0 if bad else 1, int(toxic)))
    return docs, labels


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").selectExpr("*", "'clash' as text", "'clash' as score")


CASES = [(quality_votes.quality, 1, 5, 0), (toxicity_kernel.toxicity, 2, 3, 1)]


@pytest.mark.parametrize("score,column,modulus,held", CASES)
def test_held_out_accuracy(spark, score, column, modulus, held):
    import zlib

    docs, labels = labelled()
    truth = {x[0]: x[column] for x in labels}
    rows = score(documents(spark, docs), label_table(spark, labels)).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) >= 0.95


@pytest.mark.parametrize("score,column,modulus,held", CASES)
def test_awkward_rows(spark, score, column, modulus, held):
    docs, labels = labelled(80)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (None, "no id"), (1003, "x" * 200_000), (1004, prose(3, 20_000)), (1005, "%%% !!! |||"), (1006, "a"), (5, "again with the id of another row"), (1006, "a")]
    noisy = [*labels, (5, 1, 1), (6, None, None), (None, 1, 1), (7, 3, 3)]
    rows = score(documents(spark, docs + odd), label_table(spark, noisy)).collect()
    assert len(rows) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.held_out is not None and r.predicted in (0, 1) for r in rows)
    same = {r.score for r in rows if r.doc_id in (1000, 1001)}
    assert len(same) == 1


@pytest.mark.parametrize("score,column,modulus,held", CASES)
def test_empty_tables_and_single_class(spark, score, column, modulus, held):
    docs, labels = labelled(30)
    assert score(documents(spark, []), label_table(spark, labels)).collect() == []
    assert {r.score for r in score(documents(spark, docs), label_table(spark, [])).collect()} == {0.5}
    ones = [(k, 1, 1) for k in range(30)]
    found = {r.score for r in score(documents(spark, docs), label_table(spark, ones)).collect()}
    assert all(0 <= s <= 1 for s in found)


def test_labels_do_not_leak(spark):
    """Held-out labels have no influence on any score."""
    import zlib

    docs, labels = labelled(120)
    for score, _, modulus, held in CASES:
        flipped = [(d, 1 - q, 1 - t) if zlib.crc32(str(d).encode()) % modulus == held else (d, q, t) for d, q, t in labels]
        a = {r.doc_id: r.score for r in score(documents(spark, docs), label_table(spark, labels)).collect()}
        b = {r.doc_id: r.score for r in score(documents(spark, docs), label_table(spark, flipped)).collect()}
        assert a == pytest.approx(b)


def kernel_value(a: bytes, b: bytes) -> float:
    """The subsequence kernel, by definition."""
    t = toxicity_kernel

    def vector(s):
        out, norm = {}, 0.0
        for i in range(len(s)):
            for x, y in t._PATTERNS:
                if i + 2 + x + y < len(s):
                    w = t.DECAY ** (x + y)
                    key = (s[i], s[i + 1 + x], s[i + 2 + x + y])
                    out[key] = out.get(key, 0) + w
                    norm += w * w
        return out, max(norm, 1e-9) ** 0.5

    (u, m), (v, n) = vector(a), vector(b)
    return sum(x * v.get(k, 0) for k, x in u.items()) / (m * n)


def coded(word: str) -> bytes:
    buf = np.frombuffer(word.encode(), np.uint8)
    return toxicity_kernel.coded(buf, np.array([0]), np.array([len(buf)]))[0].tobytes()


def test_kernel_rows_are_the_kernel():
    marks, words = [coded(w) for w in ("grumblor", "snivelet")], [coded(w) for w in ("grumblor", "grumbxlor", "plain", "g")]
    rows = toxicity_kernel.Kernel(*toxicity_kernel._joined(marks)).rows(*toxicity_kernel._joined(words))
    expected = [[kernel_value(w, m) for m in marks] for w in words]
    assert np.allclose(rows, expected, atol=1e-5)
    assert rows[0, 0] > rows[1, 0] > rows[2, 0]


def test_folded_scores_are_the_kernel_machine():
    """A document's score from the folded table against sums of kernels with landmarks, word by word."""
    t, r = toxicity_kernel, np.random.default_rng(6)
    marks = [coded(w) for w in ("grumblor", "snivelet", "plain", "words", "wretchok")]
    alpha, bias, logistic = r.standard_normal(len(marks)), -0.4, np.array([2.0, 0.7, -0.3])
    kernel = t.Kernel(*t._joined(marks))
    model = t.Toxicity(0.2)
    model.table = np.zeros(t._CELLS)
    model.table[kernel.cells] = kernel.vectors[:-1] @ alpha
    model.bias, model.logistic = bias, logistic
    texts = ["a plain grumbl-or met snivvelet", "wretched words, words", "", "%%%", "x", "so s n i v e l e t said", "plain " * 40]
    for text in texts:
        strings = [coded(w) for w in text.split()]
        if "s n i v" in text:
            strings.append(coded("snivelet"))
        own = sorted((sum(a * kernel_value(w, m) for a, m in zip(alpha, marks, strict=True)) + bias if len(w) > 3 else -1.0 for w in strings), reverse=True)
        two = np.maximum((own + [-1.0, -1.0])[:2], -1.0)
        buf = np.frombuffer(text.encode(), np.uint8)
        got = model.score(Block(0, buf, np.array([0, len(buf)])))[0]
        assert got == pytest.approx(1 / (1 + np.exp(-(np.r_[two, 1.0] @ logistic))), abs=1e-4), text


def test_marks_and_spelled_out_words():
    assert coded("S.n-i*v.elet!!") == coded("snivelet")
    text = "so s n i v e l e t he said"
    buf = np.frombuffer(text.encode(), np.uint8)
    found = [s.tobytes() for _, s in toxicity_kernel.spelled(Block(0, buf, np.array([0, len(buf)])))]
    assert found == [coded("snivelet")]


def test_words_tell_quality_where_marks_do_not(spark):
    r = random.Random(5)
    clean, spam = ([f"{''.join(r.choice('aeioulnrst') for _ in range(r.randrange(3, 9)))}" for _ in range(n)] for n in (400, 60))

    def text(bad):
        word = lambda: r.choice(spam if bad and r.random() < 0.5 else clean)
        return " ".join(" ".join(word() for _ in range(r.randrange(6, 14))).capitalize() + "." for _ in range(r.randrange(3, 8)))

    truth = {k: int(r.random() < 0.6) for k in range(500)}
    docs = [(k, text(not good)) for k, good in truth.items()]
    rows = quality_votes.quality(documents(spark, docs), label_table(spark, [(k, good, 0) for k, good in truth.items()])).collect()
    own = [x for x in rows if x.held_out]
    assert np.mean([x.predicted == truth[x.doc_id] for x in own]) >= 0.95


def test_words_are_hashed_without_marks_and_case():
    def row(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return quality_votes.terms(Block(0, buf, np.array([0, len(buf)])))[0, -quality_votes.WORDS :]

    assert np.array_equal(row("Some words, some %%% here"), row("here SOME so-me words."))
    assert not row("%%% | !!!").any()


def test_terms_are_gathered_without_zeros():
    q = quality_votes
    texts = [prose(k, 60, 90) for k in range(20)] + ["", "x"]
    batch = pa.RecordBatch.from_pydict({"y": [k % 2 for k in range(22)], "text": texts})
    rows = pa.Table.from_batches(list(q._features(iter([batch]))))
    raw = [t.encode() for t in texts]
    whole = q.terms(Block(0, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    assert np.array_equal(q._matrix(rows), whole) and rows.column("y").to_pylist() == [k % 2 for k in range(22)]
    assert rows.nbytes < whole.nbytes / 4


def test_votes_are_exact_cosines():
    r = np.random.default_rng(1)
    x, y = np.abs(r.standard_normal((60, quality_votes.TERMS))).astype(np.float32), r.integers(0, 2, 60)
    model = quality_votes.Votes(x, y, 0.7)
    latent, _ = model.latent(x[:5])
    for k in range(5):
        w = np.exp(quality_votes.SHARPNESS * (model.vectors @ latent[k] - 1)) * model.votes
        assert model.score(x[:5])[k] == pytest.approx(float(w[model.ones].sum() / w.sum()), abs=1e-4)


def test_scores_are_votes_in_the_latent_space_of_naive_terms():
    """Terms counted one by one, singular vectors of the whole matrix, cosines and votes in plain loops."""
    q = quality_votes
    docs, labels = labelled(60)
    block = lambda text: Block(0, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))

    def naive(text):
        out, raw = np.zeros(q.TERMS), text.encode()
        for a, b in zip(raw, raw[1:], strict=False):
            out[int(q._CLASS[a]) * q._CLASSES + int(q._CLASS[b])] += 1 / (len(raw) - 1)
        out[: q.PAIRS] = np.sqrt(out[: q.PAIRS])
        words = text.split()
        triples = list(zip(words, words[1:], words[2:], strict=False))
        seen = [np.mean([a == b for a, b in zip(words, words[1:], strict=False)]), 1 - len(set(triples)) / len(triples), (1 - len(set(words)) / len(words)) ** 2]
        out[q.PAIRS : q.PAIRS + 3] = q._REPEAT_WEIGHT * np.sqrt(seen)
        slots = [int(q.word_slots(block(w))[1][0]) for w in words if any(c.isalnum() for c in w)]
        for s in set(slots):
            out[q.PAIRS + 3 + s] = q._WORD_WEIGHT * np.sqrt(slots.count(s) / len(slots))
        return out

    x = np.array([naive(t) for _, t in docs])
    assert np.allclose(x, np.concatenate([q.terms(block(t)) for _, t in docs]), atol=1e-6)
    y, share = np.array([g for _, g, _ in labels]), 0.6
    train, test = x[:40], x[40:]
    weight = np.log1p(40 / (1 + (train > 0).sum(axis=0)))
    mean = (train * weight).mean(axis=0)
    axes = np.linalg.svd(train * weight - mean, full_matrices=False)[2][: q.RANK].T
    latent = lambda rows: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))((rows * weight - mean) @ axes)
    held, asked = latent(train), latent(test)
    want = []
    for a in asked:
        votes = [0.0, 0.0]
        for b, label in zip(held, y[:40], strict=True):
            votes[label] += np.exp(q.SHARPNESS * (float(a @ b) - 1)) * (share if label else 1 - share) / (y[:40] == label).sum()
        want.append(votes[1] / sum(votes))
    got = q.Votes(train.astype(np.float32), y[:40], share).score(test.astype(np.float32))
    assert np.allclose(got, want, atol=2e-2)


def test_helpers_table(spark):
    assert table(spark, [(1, "x")]).count() == 1
