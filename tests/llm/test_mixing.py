import math
from collections import Counter, defaultdict

import pytest

from inkstone.llm import mixing as m

from .helpers import WORD, awkward, table

SCHEMA = "doc_id bigint, text string, source string"


def corpus(n=400):
    rows = []
    for k in range(n):
        source = "hot" if k % 3 else f"s{k % 4}"
        rows.append((k, " ".join(["w"] * (1 + k % 37)), source))
    return rows


def docs(spark, rows):
    return table(spark, rows, schema=SCHEMA)


def exact_exponent(shares, target, most):
    def fits(t):
        z = sum(p**t for p in shares)
        entropy = math.log(z) - t * sum(p**t * math.log(p) for p in shares) / z
        return entropy <= target * math.log(len(shares)) + 1e-12 and max(p ** (t - 1) / z for p in shares) <= most + 1e-12

    return next(k / 10**5 for k in range(16 * 10**5 + 1) if fits(k / 10**5))


def test_weights_meet_the_target(spark):
    rows = corpus()
    own = Counter()
    for _, text, source in rows:
        own[source] += len(text.split())
    total = sum(own.values())
    t = exact_exponent([n / total for n in own.values()], 0.8, 4.0)
    z = sum((n / total) ** t for n in own.values())
    found = {r.source: r.weight for r in m.mixture(docs(spark, rows), target=0.8).select("source", "weight").distinct().collect()}
    assert found == {s: pytest.approx((n / total) ** t / z, abs=1e-4) for s, n in own.items()}


def test_repetition_limit(spark):
    rows = corpus()
    used = Counter(r.doc_id for r in m.mixture(docs(spark, rows), target=1.0, max_passes=2.0).collect())
    assert max(used.values()) <= 2


def test_a_budget_beyond_the_limit_caps_every_quota(spark):
    rows = corpus()
    total = sum(len(t.split()) for _, t, _ in rows)
    out = m.report(docs(spark, rows), budget=10 * total, max_passes=2.0).collect()
    assert all(r.mixed_tokens == r.quota == 2 * r.source_tokens for r in out)
    half = m.report(docs(spark, rows), budget=10 * total, max_passes=1.5).collect()
    assert all(r.quota == math.floor(1.5 * r.source_tokens) and r.source_tokens < r.mixed_tokens <= r.quota for r in half)


def test_a_mix_of_more_entropy_than_the_target_gets_an_exponent_above_one(spark):
    rows = [(k, "w " * (10 + k % 3), f"s{k % 3}") for k in range(300)]
    own = Counter()
    for _, text, source in rows:
        own[source] += len(text.split())
    total = sum(own.values())
    t = exact_exponent([n / total for n in own.values()], 0.9, 4.0)
    assert t > 1
    z = sum((n / total) ** t for n in own.values())
    found = {r.source: r.weight for r in m.report(docs(spark, rows), target=0.9).collect()}
    assert found == {s: pytest.approx((n / total) ** t / z, abs=1e-4) for s, n in own.items()}


def test_equal_sources_keep_their_shares_whatever_the_target(spark):
    rows = [(k, "w w w", f"s{k % 4}") for k in range(80)]
    assert {r.weight for r in m.report(docs(spark, rows), target=0.5).collect()} == {0.25}


def test_sources_with_long_documents_are_filled_or_listed(spark):
    rows = [(0, "w " * 5000, "a"), *((k, "w " * 10, "a") for k in range(1, 60)), *((k, "w " * 40, "b") for k in range(60, 200)), (900, "w " * 3000, "only")]
    out = {r.source: r for r in m.report(docs(spark, rows), budget=1500, target=0.99).collect()}
    assert set(out) == {"a", "b", "only"}
    assert out["only"].quota > 0 and out["only"].mixed_tokens == 0  # its one document is longer than its quota
    for s, size in (("a", 10), ("b", 40)):
        assert 0 <= out[s].quota - out[s].mixed_tokens < size


@pytest.mark.parametrize("most", [0, 2])
def test_many_sources_give_the_same_mix(spark, monkeypatch, most):
    want = sorted(map(tuple, m.mixture(docs(spark, corpus())).collect()))
    monkeypatch.setattr(m, "BROADCAST_SOURCES", most)
    assert sorted(map(tuple, m.mixture(docs(spark, corpus())).collect())) == want


def test_blocks_are_budgeted_permutations(spark):
    rows, size = corpus(), {}
    for k, text, _ in rows:
        size[k] = len(text.split())
    total = sum(size.values())
    out = m.mixture(docs(spark, rows), budget=2 * total, target=0.9).collect()
    blocks, weight, source = defaultdict(list), {}, {k: s for k, _, s in rows}
    for r in out:
        assert source[r.doc_id] == r.source and r.n_tokens == size[r.doc_id]
        blocks[(r.source, r.block)].append(r)
        weight[r.source] = r.weight
    for s, w in weight.items():
        quota = math.floor(w * 2 * total)
        own = sum(n for k, n in size.items() if source[k] == s)
        whole, rest = divmod(quota, own)
        ids = sorted(k for k in size if source[k] == s)
        for block in range(whole):
            assert sorted(r.doc_id for r in blocks[(s, block)]) == ids
        last = blocks.get((s, whole), [])
        assert len({r.doc_id for r in last}) == len(last)
        assert sum(r.n_tokens for r in last) <= rest
        assert rest - sum(r.n_tokens for r in last) < max(size.values())
        order = sorted((r for b in range(whole + 1) for r in blocks.get((s, b), [])), key=lambda r: r.mix_order)
        at = 0
        for r in order:
            assert r.mix_order == pytest.approx(at / quota)
            at += r.n_tokens


def test_buckets_do_not_change_the_budget(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET", 16)
    test_blocks_are_budgeted_permutations(spark)


def test_same_rows_give_the_same_mix(spark):
    a = sorted(map(tuple, m.mixture(docs(spark, corpus())).collect()))
    b = sorted(map(tuple, m.mixture(docs(spark, corpus()[::-1]).repartition(7)).collect()))
    assert a == b


def test_awkward_rows(spark):
    rows = [(d, t, None if (d or 0) % 2 else "") for d, t in awkward()]
    out = m.mixture(docs(spark, rows)).collect()
    some = {d for d, t, _ in rows if d is not None and WORD.findall(t or "")}
    assert {r.doc_id for r in out} <= some
    assert {r.source for r in out} == {""}
    assert m.mixture(docs(spark, [])).collect() == []
    assert m.mixture(docs(spark, [(1, None, "a"), (2, "", "b")])).collect() == []
