"""Recall of op4's filters: on planted pairs at the threshold, at several sizes, and through Spark."""

import math

import numpy as np
import pytest

from graphloom.llm import embedding_dups


def planted(n, dim, cosines, seed=3):
    """n unit vectors; the second half are partners of the first, at the cosines in turn."""
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=(2, n // 2, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = np.resize(np.array(cosines), len(x))[:, None]
    return x, c * x + np.sqrt(1 - c * c) * z


@pytest.mark.parametrize(("n", "dim"), [(500, 64), (5_000, 64), (20_000, 64), (100_000, 64), (5_000_000, 64), (20_000, 3), (100_000, 384)])
def test_filters_find_pairs(n, dim):
    codes = embedding_dups.fitted(n, dim, 0.95)
    x, y = planted(8000, dim, [0.951, 0.96, 0.97])
    a, b = embedding_dups._decode(codes, x), embedding_dups._decode(codes, y)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.98


@pytest.mark.parametrize("n", [500, 5_000, 20_000])
def test_links_of_planted_pairs(spark, n):
    x, y = planted(n, 64, [0.951, 0.96, 0.97])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    both = np.concatenate([x, y])
    near = sum(int((both[k : k + 1000] @ both.T >= 0.95).sum()) for k in range(0, n, 1000)) - n
    got = embedding_dups.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == n and near >= n and math.fsum(r["n_links"] for r in got) >= 0.98 * near
