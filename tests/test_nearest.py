"""The k best by tiles of matrix products, against each pair scored alone."""

import tracemalloc

import numpy as np
import pytest

from bitempo.operators import vector
from bitempo.operators.vector import Nearest


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_tiles_against_each_pair(monkeypatch, metric, k):
    """Small tiles, copies of a vector (ties go by id) and rows that must match."""
    monkeypatch.setattr(vector, "STEP", 7)
    monkeypatch.setattr(vector, "TILE", 64)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(9, 8))
    base /= np.sqrt((base**2).sum(axis=1, keepdims=True))
    x = base[rng.integers(0, 9, 100)]
    names = rng.permutation(100)
    q, ids = x[:30], np.arange(30) + 500
    own, theirs = np.arange(30) % 3, np.arange(100) % 3
    best = Nearest(ids, q, k, metric)
    for low in range(0, 100, 33):
        best.add(names[low : low + 33], x[low : low + 33], [(own, theirs[low : low + 33])])
    got = sorted((a, b, s) for t in best.rows() for a, b, s in zip(*(c.to_pylist() for c in t.columns), strict=True))
    want = []
    for i in range(30):
        s = vector.exact_scores(np.repeat(q[i : i + 1], 100, axis=0), x, metric)
        some = sorted((-s[j], names[j]) for j in range(100) if own[i] == theirs[j])[:k]
        want += [(int(ids[i]), int(n), float(-v)) for v, n in some]
    assert got == sorted(want)


def test_distances_hold_a_tile_only():
    """4,096 queries against 4,096 rows: every difference at once would be 2 GB a thousand rows."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4096, 64))
    tracemalloc.start()
    best = Nearest(np.arange(4096), x, 10, "l2")
    best.add(np.arange(4096), x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    assert (best.found[:, 0] == np.arange(4096)).all()
