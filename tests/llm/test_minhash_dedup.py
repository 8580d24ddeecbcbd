import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkstone.llm import minhash_dedup as m
from inkstone.llm import shared
from inkstone.llm.shared import components

from .helpers import WORD, awkward, documents, first_texts, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for doc_id, text in first_texts(rows).items():
        words = WORD.findall(text.translate(LOWER))
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def brute_by_shingles(rows):
    """As brute(), with only the pairs that share a shingle."""
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    held, shared, up = defaultdict(list), Counter(), {d: d for d in sets}
    for d, own in sorted(sets.items()):
        for s in own:
            shared.update((e, d) for e in held[s])
            held[s].append(d)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def run(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(df).collect()}


def edited(text, changes, seed):
    r = random.Random(seed)
    words = text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def test_awkward_rows_match_brute_force(spark):
    assert run(documents(spark)) == brute(awkward())


def test_near_copies_and_chains(spark):
    base = prose(9, 300)
    rows = [(k, edited(base, k % 6, k)) for k in range(40)] + [(100 + k, prose(500 + k, 80)) for k in range(20)]
    chain = prose(11, 200)
    for k in range(12):  # each a little further from the first
        chain = edited(chain, 2, 1000 + k)
        rows.append((200 + k, chain))
    assert run(documents(spark, rows)) == brute(rows)


def test_a_large_unit_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(m, "PART", 8)
    monkeypatch.setattr(shared, "HUB_EDGES", 20)  # the unit is broadcast to its members
    base = prose(21, 250)
    rows = [(k, edited(base, 3, k)) for k in range(50)]
    assert run(documents(spark, rows)) == brute(rows)


def test_what_no_hub_reached_is_compared_in_blocks(spark, monkeypatch):
    part, exact = 8, m._exact

    def guarded(percent, matches):
        real = exact(percent, matches)

        def run(key, hubs, members):
            if max(hubs.num_rows, members.num_rows) > 4 * part:
                raise MemoryError(f"{hubs.num_rows} hubs and {members.num_rows} members in one group")
            return real(key, hubs, members)

        return run

    monkeypatch.setattr(m, "PART", part)
    monkeypatch.setattr(m, "_exact", guarded)
    base = prose(23, 300)
    rows = [(k, edited(base, 12, k)) for k in range(120)]
    rows += [(200 + k, edited(rows[5 * k][1], 1, 900 + k)) for k in range(20)]
    assert sum(c != d for d, (_, c, _) in brute(rows).items()) == 20
    assert run(documents(spark, rows)) == brute(rows)


def test_matches_needed_bounds_the_miss():
    assert m.matches_needed(1.0) == m.COORDINATES
    assert 10 <= m.matches_needed(0.85) <= 20


def test_forest_spans_without_all_pairs():
    sig = np.zeros((200, m.COORDINATES), np.uint32)
    assert len(m.forest(np.arange(200), sig, 15)) == 199


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 30) if k != 14] + [(40, 40), (50, 7)], "a bigint, b bigint")
    found = defaultdict(set)
    for r in components(edges).collect():
        found[r.component].add(r.node)
    assert dict(found) == {0: {*range(15), 50}, 15: set(range(15, 31))}


@pytest.mark.parametrize("ids", ["descending", "random"])
def test_components_of_a_long_path_take_few_rounds(spark, ids):
    nodes = [0, *range(500, 0, -1)] if ids == "descending" else random.Random(3).sample(range(10**6), 501)
    rounds = []
    found = components(spark.createDataFrame(list(zip(nodes, nodes[1:])), "a bigint, b bigint"), rounds).collect()
    assert {r.node: r.component for r in found} == dict.fromkeys(nodes, min(nodes)) and len(found) == len(nodes)
    assert len(rounds) <= 20


@pytest.mark.parametrize("hub_edges", [1000, 3])
def test_components_match_brute_force_on_random_graphs(spark, monkeypatch, hub_edges):
    monkeypatch.setattr(shared, "HUB_EDGES", hub_edges)
    r = random.Random(8)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(7, 400 + k) for k in range(100)]
    up = {n: n for p in pairs for n in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    some = {n for a, b in pairs if a != b for n in (a, b)}
    found = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {n: top(n) for n in some}


def test_few_edges_take_no_rounds(spark):
    nodes = random.Random(3).sample(range(10**12), 501)
    rounds = []
    found = components(spark.createDataFrame(list(zip(nodes, nodes[1:])), "a bigint, b bigint"), rounds).collect()
    assert {r.node: r.component for r in found} == dict.fromkeys(nodes, min(nodes)) and len(found) == len(nodes)
    assert rounds == []


@pytest.mark.parametrize("driver_edges,hub_edges", [(0, 1000), (0, 3), (20, 1000)])
def test_rounds_find_what_the_driver_finds(spark, monkeypatch, driver_edges, hub_edges):
    r = random.Random(11)
    path = [0, *range(1500, 1000, -1)]
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(7, 400 + k) for k in range(100)] + list(zip(path, path[1:])) + [(2000, 2000)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    found = sorted(components(edges).collect())
    monkeypatch.setattr(shared, "HUB_EDGES", hub_edges)
    monkeypatch.setattr(shared, "DRIVER_EDGES", driver_edges)
    rounds = []
    assert sorted(components(edges, rounds).collect()) == found
    assert 1 <= len(rounds) <= 20


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([(3, 3)], "a bigint, b bigint")).collect() == []


def test_a_drifting_chain_with_adverse_ids(spark):
    text, rows = prose(31, 150, 5000), []
    r = random.Random(5)
    for k, doc_id in enumerate([0, *range(1000, 1, -1)]):
        words = text.split()
        words[(k * 7) % 150] = f"drift{r.randrange(10**9)}"
        text = " ".join(words)
        rows.append((doc_id, text))
    assert run(documents(spark, rows)) == brute_by_shingles(rows)


def test_empty_table(spark):
    assert run(documents(spark, [])) == {}
