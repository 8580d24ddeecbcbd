import hashlib

import numpy as np
import pytest

from inkstone.llm import substring_dedup as s
from inkstone.llm.substring_dedup import remove_repeats

from .helpers import WORD, awkward, documents, first_texts, prose


def brute(rows, window=20):
    seen, out = set(), {}
    for doc_id, text in sorted(first_texts(rows).items()):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            own = tuple(words[k : k + window])
            if own in seen:
                gone[k : k + window] = [True] * window
            seen.add(own)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run(df, **options):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df, **options).collect()}


def test_awkward_rows_match_brute_force(spark):
    assert run(documents(spark)) == brute(awkward())


def test_passages_shared_by_many_documents(spark):
    passage = prose(50, 60)
    rows = [(k, prose(100 + k, 30) + " " + passage + " " + prose(200 + k, 25)) for k in range(60)] + [(k, passage) for k in range(100, 140)]
    assert run(documents(spark, rows)) == brute(rows)


@pytest.mark.parametrize("window,prefix", [(20, 8), (6, 3), (5, 5)])
def test_windows(spark, window, prefix):
    rows = [(k, prose(k % 7, 80, 12)) for k in range(25)]
    assert run(documents(spark, rows), window=window, prefix=prefix) == brute(rows, window)


def test_repeats_are_the_removed_ranges(spark):
    rows = [(1, prose(1, 50)), (2, "new words first " + prose(1, 50))]
    found = {r.doc_id: r.repeats for r in remove_repeats(documents(spark, rows)).collect()}
    assert found == {1: [], 2: [[3, 53]]}


def test_empty_table(spark):
    assert run(documents(spark, [])) == {}


@pytest.mark.parametrize("most", [1, 6, 10_000])
def test_prefixes_lengthen_until_a_group_fits(spark, monkeypatch, most):
    """Groups of 8, 14 and 20 words, by how many suffixes one may have."""
    passage, other = prose(50, 60), prose(51, 200, 9)
    rows = [(k, prose(100 + k, 30) + " " + " ".join(passage.split()[k % 9 : 50 + k % 5]) + f" end{k % 3} " + prose(200 + k, 25)) for k in range(40)]
    rows += [(k, other if k % 2 else prose(60, 30) + " " + other[k:]) for k in range(100, 112)]
    lengths = set()
    real = s._suffixes

    def noted(window, prefix, n, over, over_longer):
        lengths.update({8} | ({14} if len(over.value) else set()) | ({20} if len(over_longer.value) and len(over.value) else set()))
        return real(window, prefix, n, over, over_longer)

    monkeypatch.setattr(s, "_suffixes", noted)
    monkeypatch.setattr(s, "GROUP_BYTES", most * (20 + s.WORD * 32))
    assert run(documents(spark, rows)) == brute(rows)
    assert lengths == ({8} if most == 10_000 else {8, 14, 20})


def test_equal_suffixes_leave_a_task_once(monkeypatch):
    words = np.arange(32 * 3, dtype=np.uint64).reshape(3, 32)
    out = s._Suffixes(4)
    k = 1000
    of = np.arange(k) % 3
    list(out.add(of.astype(np.uint64), np.arange(k), np.zeros(k, int), np.ones(k, np.int64), words[of]))
    rows = [b.to_pylist() for b in out.deal()]
    posted = [r for b in rows for r in b if r["labels"] is not None]
    known = [r for b in rows for r in b if r["labels"] is None]
    assert sum(len(r["docs"]) // 8 for r in posted) == 3 and sum(len(r["docs"]) // 8 for r in known) == k - 3


def test_a_subtree_tells_left_contexts_apart():
    """Three suffixes that share their words to the right; two of them share the word to the left as well."""
    left = 2
    words = np.array([[1, 2, 5, 6, 7, 8], [9, 2, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8]], np.uint64)
    got = s.subtree_repeats(np.zeros(3, np.uint64), np.arange(3), np.zeros(3, int), np.full(3, 0b111), words, 4, left)
    assert got.tolist() == [0, 0b011, 0b001]
