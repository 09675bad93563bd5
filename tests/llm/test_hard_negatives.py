"""Hard negatives against a plain search: on the given table, with many cells and groups, copies, ties and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hard_negatives
from graphloom.llm.queries import QUERIES

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, is_anchor, positives=5, negatives=3):
    """``rows`` of (id, label, whole components)."""
    rows = sorted({(i, y, tuple(v)) for i, y, v in rows})
    width = max((len(r[2]) for r in rows), default=0)
    out = []
    for a in rows:
        if not is_anchor(a[0]):
            continue
        scored = [(-sum(int(x) * int(y) for x, y in zip(a[2], r[2], strict=False)), r[0], r) for r in rows if r != a]
        scored.sort()
        assert width >= 0
        for s, i, _ in [x for x in scored if x[2][1] == a[1]][:positives]:
            fit = [x for x in scored if x[2][1] != a[1] and -50 * s <= -100 * x[0] <= -95 * s][:negatives]
            out += [(a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def test_given_table(spark, sf_dir):
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect():
        if r["label"] is None or r["embedding"] is None or any(x is None or not math.isfinite(x) for x in r["embedding"]):
            continue
        rows.append((r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [math.floor(256 * x) for x in r["embedding"]]))
    want = plain(rows, lambda i: i % 50 == 0)
    assert want and found(QUERIES["op11_hard_negatives"](spark, sf_dir)) == want


def _planted(seed, n=600, dim=6):
    """Clusters, a third of the rows copies of one vector, ties, negative scores."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 8
    v = np.rint(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim))).astype(int)
    v[rng.random(n) < 0.33] = v[0]
    return [(int(i), int(y), [float(x) for x in r]) for i, y, r in zip(range(n), rng.integers(0, 4, n), v, strict=True)]


@pytest.mark.parametrize("pivots", [1, 40])
def test_cells_groups_and_copies(spark, monkeypatch, pivots):
    for name, value in (("CELL_ROWS", 10 if pivots > 1 else 10**6), ("GROUP_ROWS", 7), ("SLICE_ROWS", 16), ("OWN_CELLS", 1)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = _planted(pivots)
    rows += rows[:30] + [(7, 1, [1.0] * 6), (20, rows[20][1], [2.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert found(hard_negatives.mine(df, F.col("vec_id") % 10 == 0)) == plain(rows, lambda i: i % 10 == 0)


def test_bounds_leave_rows_out(spark):
    """The second round's bounds keep far cells away from a group, and lose nothing (compared above)."""
    rng = np.random.default_rng(1)
    p = rng.normal(size=(20, 4))
    v = hard_negatives.Voronoi(p, float((p**2).sum(1).max()))
    q, x = rng.normal(size=(50, 4)), p[rng.integers(0, 20, 200)]
    score, d, to = q @ x.T, v.rows(x), v.anchors(q)
    reach = np.sqrt(np.maximum((q**2).sum(1)[:, None] + v.radius2 - 2 * score, 0))
    for j in range(20):
        assert (np.abs(to[:, j : j + 1] - d[None, :, j]) <= reach + v.slack).all()


def test_large_numbers(spark):
    rows = [(k, k % 2, [float(2**30 + 3 * k), float(2**31 - k)]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert found(hard_negatives.mine(df, F.col("vec_id") % 10 == 0, least_percent=0, most_percent=100))
    q = np.array([[2.0**40, 3.0]])
    assert hard_negatives.scores(q, np.array([[2.0**20 + 1, 5.0]])).tolist() == [[2**60 + 2**40 + 15]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [4.0, 0.0]), (1, 1, [4.0]), (2, 2, [3.0, 0.0]), (3, None, [3.0, 0.0]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (7, 2, [None, 1.0]), (None, 2, [3.0, 0.0]), (8, 2, []), (2, 2, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").select("*", *(F.lit("x").alias(c) for c in ("id", "a", "v", "cell", "score", "anchor", "x")))
    assert found(hard_negatives.mine(df, F.col("vec_id") == 0)) == [(0, 1, 1, 2, 16, 12)]
    assert found(hard_negatives.mine(df.limit(0), F.col("vec_id") == 0)) == []
    assert found(hard_negatives.mine(df, F.col("vec_id") == 99)) == []
