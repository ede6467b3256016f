"""The trees of the quality classifier against a naive split search and a walk from node to node."""

import numpy as np
import pytest

from fathomline.llm.quality import BINS, fit_forest


def table(rows=300, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=rows), rng.integers(0, 6, rows).astype(float), np.zeros(rows)], axis=1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] >= 4)).astype(float)
    return x, np.where(rng.random(rows) < 0.05, 1 - y, y)


def walk(forest, row):
    """One row down every tree, node by node."""
    inner, z = forest.feature.shape[1], forest.base
    for t in range(len(forest.feature)):
        i = 0
        while i < inner:
            i = 2 * i + (2 if row[forest.feature[t, i]] > forest.threshold[t, i] else 1)
        z += forest.leaf[t, i - inner]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_traversal(depth):
    x, y = table()
    forest = fit_forest(x, y, trees=7, depth=depth)
    odd = np.concatenate([x[:50], [[np.inf, -np.inf, 0.0], [0.0, 0.0, 5.0]], [[e, 4.0, 0.0] for e in forest.threshold[:, 0] if np.isfinite(e)]])
    assert forest.predict(odd) == pytest.approx([walk(forest, row) for row in odd])
    assert forest.predict(odd[:0]).shape == (0,)


def test_every_split_is_the_best():
    """Each node of each tree splits where a search over all features and bin edges finds the greatest gain."""
    x, y = table()
    trees, depth, rate, ridge = 3, 3, 0.2, 1.0
    forest = fit_forest(x, y, trees=trees, depth=depth, rate=rate, ridge=ridge)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    z, inner = np.full(len(y), forest.base), 2**depth - 1
    assert forest.base == pytest.approx(np.log(y.mean() / (1 - y.mean())))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        worth = lambda m, g=g, h=h: g[m].sum() ** 2 / (h[m].sum() + ridge)
        held = {0: np.ones(len(y), dtype=bool)}
        for i in range(inner):
            m, best = held[i], 0.0
            for j, cuts in enumerate(edges):
                for cut in cuts:
                    left, right = m & (x[:, j] <= cut), m & (x[:, j] > cut)
                    if h[left].sum() >= 2 and h[right].sum() >= 2:
                        best = max(best, worth(left) + worth(right) - worth(m))
            goes = x[:, forest.feature[t, i]] > forest.threshold[t, i]
            left, right = m & ~goes, m & goes
            held[2 * i + 1], held[2 * i + 2] = left, right
            got = worth(left) + worth(right) - worth(m) if right.any() and left.any() else 0.0
            assert got == pytest.approx(best, abs=1e-6)
        for k in range(inner + 1):
            m = held[inner + k]
            assert forest.leaf[t, k] == pytest.approx(rate * g[m].sum() / (h[m].sum() + ridge))
            z[m] += forest.leaf[t, k]
