import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import curve_search as c

from .helpers import table

SCHEMA = "vec_id bigint, embedding array<float>"


def vectors(n=600, d=16, seed=4):
    return np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)


def exact(x, ids, queries, k=5):
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        score = (x[i] * x).sum(axis=1) / (norm[i] * norm)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def run(df, **options):
    out = {}
    for r in c.search(df, F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_one_range_is_exact(spark):
    x = vectors()
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    found, wanted = run(table(spark, rows, schema=SCHEMA), blocks=1), exact(x, np.arange(len(x)), range(0, 600, 50))
    assert {q: [i for i, _ in own] for q, own in found.items()} == {q: [i for i, _ in own] for q, own in wanted.items()}
    for q, own in found.items():
        assert np.allclose([s for _, s in own], [s for _, s in wanted[q]], rtol=0, atol=1e-12)


def recall(found, wanted):
    return sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in own}) for q, own in wanted.items()) / sum(map(len, wanted.values()))


def test_recall(spark):
    x = vectors(8000, 64)
    wanted = exact(x, np.arange(len(x)), range(0, len(x), 50))
    assert recall(run(table(spark, [(k, v.tolist()) for k, v in enumerate(x)], schema=SCHEMA)), wanted) >= 0.9


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_and_comparisons_against_random_keys(monkeypatch, clustered):
    """50,000 vectors of 64 independent coordinates, or around 500 centres: less than half a scan, and random keys find far less."""
    n, x = 50_000, vectors(50_000, 64)
    if clustered:
        x = x + 3 * vectors(500, 64, 9)[np.random.default_rng(2).integers(0, 500, n)]
    units, ids, asked = c.unit(x.astype(np.float64)), np.arange(n), np.arange(0, n, 250)
    near = units[asked] @ units.T
    near[np.arange(len(asked)), asked] = -1
    wanted = np.argpartition(-near, 5, axis=1)[:, :5]
    found = {}
    for name, keys in (("curve", [c.curve_keys(units, k) for k in range(c.CURVES)]), ("random", [np.random.default_rng(k).integers(0, 1 << 60, n) for k in range(c.CURVES)])):
        own = np.stack([k[:20_000] for k in keys], axis=1)
        ranges = c.Ranges({64: own}, n, n // 50, c.BLOCKS, c.BLOCK_ROWS)
        met, hit = 0, np.zeros(wanted.shape, bool)
        for curve, key in enumerate(keys):
            block, deal = ranges.at(64, curve, key)
            assert (deal == 1).all()
            size = np.bincount(block, minlength=len(deal) + 2)
            met += sum(size[np.maximum(block[asked] + d, -1)].sum() for d in (-1, 0, 1))
            hit |= np.abs(block[wanted] - block[asked][:, None]) <= 1
        found[name] = (hit.mean(), met / len(asked) / n)
    assert found["curve"][0] >= 0.9 and found["curve"][1] < 0.5
    assert found["random"][0] < 0.5


def test_cells_bound_what_meets_and_lose_nothing(spark, monkeypatch):
    x = np.concatenate([vectors(500, 16), np.tile(vectors(1, 16, 7), (300, 1)) * (1 + 0.3 * vectors(300, 16, 8))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    want = run(table(spark, rows, schema=SCHEMA), blocks=20, block_rows=10)
    monkeypatch.setattr(c, "CELL_ROWS", 20)
    monkeypatch.setattr(c, "CELL_QUERIES", 2)
    assert run(table(spark, rows, schema=SCHEMA), blocks=20, block_rows=10) == want


def test_ties_copies_and_unusable_vectors(spark):
    hot, other = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(k, hot) for k in range(200)] + [(200, other), (201, [2.0, 4.0, 6.0]), (202, None), (203, [0.0, 0.0, 0.0]), (204, [1.0, None, 2.0]), (250, [1.0, float("nan"), 2.0]), (300, [float("inf"), 1.0, 1.0]), (350, []), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (None, hot), (201, [2.0, 4.0, 6.0])]
    found = run(table(spark, rows, schema=SCHEMA))
    assert set(found) == {0, 50, 100, 150, 200, 400}
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in found[50]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in found[200]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in found[400]] == [401]  # the only other vector of its length


def test_very_small_and_very_large_components(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2e200]), (2, [1.0, -1.0]), (3, [2e-300, 4e-300])]
    found = run(table(spark, rows, schema="vec_id bigint, embedding array<double>"))
    assert [i for i, _ in found[0]] == [1, 3, 2]
    assert found[0][0][1] == pytest.approx(1, abs=1e-12)


def test_fewer_candidates_and_empty_table(spark):
    found = run(table(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.5])], schema=SCHEMA))
    assert [i for i, _ in found[0]] == [1, 2]
    assert run(table(spark, [], schema=SCHEMA)) == {}
    assert run(table(spark, [(0, [1.0])], schema=SCHEMA)) == {}


def test_hilbert_neighbours_are_adjacent_cells():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = c.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
