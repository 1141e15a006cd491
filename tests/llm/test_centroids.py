"""Centroid clustering against all distances in Python's integers."""

import hashlib
import math

import numpy as np
import pytest
from tests.llm.conftest import rows_of

from claimscope.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, label int"


def brute(rows, k=16, rounds=3):
    """``vec_id, cluster, distance`` and the centroids."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    hashed = [("~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept]
    cs = [v for _, v in sorted(hashed)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), j in zip(kept, of, strict=True) if j == c] for c in range(len(cs))]
        cs = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, cs, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    return sorted(found, key=repr), cs


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("seed,scale", [(1, 1.0), (2, 0.02), (3, 5e4)])
def test_cluster(spark, seed, scale):
    """Tight values give ties and repeated rows, wide ones integers beyond one machine word's squares."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=64) * scale).astype(np.float32).tolist()) for i in range(150)]
    rows += rows[:5] + [(7, rows[9][1]), (None, rows[3][1])]
    got, cs = centroids.cluster(table(spark, rows))
    want, want_cs = brute(rows)
    assert rows_of(got) == want and cs == want_cs


def test_vectors_that_take_no_part(spark):
    good = [0.25] * 64
    rows = [(1, good), (2, None), (3, [0.0] * 63), (4, [float("nan")] + good[1:]), (5, [None] + good[1:]), (6, good[1:] + [float("-inf")]), (8, [-1.0] * 64), (9, [])]
    got = {r.vec_id: r for r in centroids.cluster_report(table(spark, rows)).collect()}
    assert sorted(got) == [1, 8] and all(r.distance == r.inertia == r.cluster_inertia == 0 for r in got.values())
    assert got[1].centroid_sha256 == hashlib.sha256(",".join(["16"] * 64).encode()).hexdigest()
    assert centroids.cluster_report(table(spark, [(2, None)])).collect() == []


def test_huge_components(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] * 64) for i in range(20)]
    got, cs = centroids.cluster(table(spark, rows), k=2)
    assert (rows_of(got), cs) == (lambda w: (sorted(((i, c, min(d, 2**63 - 1)) for i, c, d in w[0]), key=repr), w[1]))(brute(rows, k=2))


def test_search_is_exact_and_spares_differences():
    rng = np.random.default_rng(4)
    c = rng.integers(-60, 60, (16, 64))
    v = c[rng.integers(0, 16, 500)] + rng.integers(-3, 4, (500, 64))
    of, d, added = centroids.nearest(v, c)
    all_ = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (of == all_.argmin(axis=1)).all() and (d == all_.min(axis=1)).all()
    assert added < 0.4 * 500 * 16 * 64
    same = np.zeros((9, 64), dtype=np.int64)
    of, d, _ = centroids.nearest(same, np.ones((5, 64), dtype=np.int64))
    assert (of == 0).all() and (d == 64).all()


def test_transform():
    x = np.random.default_rng(6).integers(-9, 9, (7, 64))
    assert (centroids.transform(centroids.transform(x)) == 64 * x).all()
    assert (centroids.transform(x)[:, centroids.ORDER[0]] == x.sum(axis=1)).all()
