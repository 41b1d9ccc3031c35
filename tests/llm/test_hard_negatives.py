import math

import numpy as np
import pytest

from strikeflow.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, extra string, unit int, anchor string"


def plain(rows, every=50, positives=5, negatives=3):
    rows = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, l in rows:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, m) for j, w, m in rows if j != i)
        for s, j, _ in [r for r in scored if r[2] == l][:positives]:
            p = -s
            near = [(-t, k) for t, k, m in scored if m != l and 50 * p <= -100 * t <= 95 * p][:negatives]
            out += [(i, j, n + 1, k, p, t) for n, (t, k) in enumerate(near)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "e", 1, "a") for i, v, l in rows], SCHEMA)


def clustered(seed, n, d=16, centres=9):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, d))
    of = rng.integers(0, centres, n)
    x = middle[of] + 0.4 * rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), [float(c) for c in np.float32(v)], int(rng.integers(0, 4)) if rng.random() < 0.3 else int(of[i] % 4)) for i, v in enumerate(x)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 32)
    monkeypatch.setattr(H, "UNIT", 128)


@pytest.mark.parametrize(("seed", "n", "d"), [(1, 700, 16), (2, 500, 3), (3, 300, 80), (4, 60, 1)])
def test_as_by_brute_force(spark, small, seed, n, d):
    rows = clustered(seed, n, d)
    got = sorted(tuple(r) for r in H.hard_negatives(frame(spark, rows), every=10).collect())
    assert got == plain(rows, every=10) and bool(got) == (d > 1)


def test_production_sizes(spark):
    rows = clustered(5, 900)
    assert sorted(tuple(r) for r in H.hard_negatives(frame(spark, rows)).collect()) == plain(rows)


def test_odd_rows(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = clustered(6, 250, 8)
    rows += [(50, [0.1] * 8, None), (100, None, 1), (150, [nan] * 8, 1), (200, [0.1, None] * 4, 2), (None, [0.1] * 8, 1), (350, [inf] + [0.0] * 7, 1), (400, [], 1), (450, [0.5, 0.5], 2), (500, [0.0] * 8, 3)]
    rows += [(i, v, 3) for i, v, _ in rows[:40]] + [(1000 + k, rows[5][1], k % 2) for k in range(120)] + [(-50, rows[7][1], 0)]
    got = sorted(tuple(r) for r in H.hard_negatives(frame(spark, rows)).collect())
    assert got == plain(rows) and any(r[0] == -50 for r in got)


def test_numbers_beyond_float64(spark, small):
    rows = [(i, [x * 1e7 for x in v], l) for i, v, l in clustered(7, 120, 4)]
    got = sorted(tuple(r) for r in H.hard_negatives(frame(spark, rows), every=10).collect())
    assert got == plain(rows, every=10) and max(r[4] for r in got) > 1 << 60


def test_no_rows(spark):
    for rows in ([], [(50, None, 1)], [(50, [], 1)], [(50, [0.5, 0.5], 1)], [(50, [0.5], 1), (51, [0.5], 1)]):
        assert H.hard_negatives(frame(spark, rows)).count() == 0


def test_curve_visits_every_cell_next_to_the_last():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        at = H.hilbert(grid, bits)
        assert sorted(at.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_spare_blocks():
    rng = np.random.default_rng(8)
    x = np.floor(rng.standard_normal((40, 6)) * 50)
    zone = H.Zones([x.min(0).tobytes()], [x.max(0).tobytes()], [1], [3], 6)
    a = np.floor(rng.standard_normal((30, 6)) * 50)
    low, high = zone.bounds(a)
    s = a @ x.T
    assert (low[:, 0] <= s.min(1)).all() and (high[:, 0] >= s.max(1)).all()
    assert zone.may_hold(np.array([0, 1, 4]), True)[:, 0].tolist() == [False, True, False]
    assert H.Zones([x[0].tobytes()], [x[0].tobytes()], [2], [2], 6).may_hold(np.array([2, 3]), False)[:, 0].tolist() == [False, True]
