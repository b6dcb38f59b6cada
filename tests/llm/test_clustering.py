"""Clusters by Elkan's bounds against measuring every distance."""

import hashlib

import numpy as np
import pytest

from newsloom.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, x int, v string"


def brute(rows, k, rounds, dim, scale):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in e]) for i, e in rows
            if e is not None and len(e) == dim and all(c is not None and np.isfinite(c) for c in e)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        to = [nearest(v)[1] for _, v in kept]
        for n in range(len(centres)):
            own = [v for (_, v), c in zip(kept, to, strict=True) if c == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    out = [(i, *nearest(v)) for i, v in kept]
    per = {n: sum(d for _, d, c in out if c == n) for n in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, d, c in out), key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, e, 0, "c", 1, "v") for i, e in rows], SCHEMA)
    return sorted((tuple(r) for r in clustering.elkan_clusters(df, **how).collect()), key=str)


@pytest.mark.parametrize(("scale", "spread"), [(1, 2), (256, 1)])
def test_clusters_ties_copies_odd_rows(spark, scale, spread):
    rng = np.random.default_rng(scale)
    near = rng.normal(size=(6, 4)) * 3
    rows = [(i, (near[i % 6] + rng.normal(size=4) * spread).tolist()) for i in range(150)]
    rows += [(200 + i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)]  # many ties at scale 1
    rows += [(300 + i, [1.0, 1.0, -1.0, 0.5]) for i in range(40)] + [(7, [0.0] * 4), (7, [0.25, 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf")] * 4), (405, [1.0] * 5)]
    how = {"k": 8, "rounds": 4, "dim": 4, "scale": scale}
    assert found(spark, rows, **how) == brute(rows, **how)


def test_few_and_none(spark):
    how = {"k": 5, "rounds": 2, "dim": 2, "scale": 10}
    rows = [(1, [0.5, 0.5]), (2, [0.1, 0.9])]
    assert found(spark, rows, **how) == brute(rows, **how)
    assert found(spark, [(3, None)], **how) == found(spark, [], **how) == []


def test_large_components(spark):
    how = {"k": 2, "rounds": 2, "dim": 2, "scale": 1}
    rows = [(i, [float(x), -float(x)]) for i, x in enumerate((1 << 26, 3, 1 << 25, -(1 << 26)))]
    assert found(spark, rows, **how) == brute(rows, **how)
    with pytest.raises(Exception, match="component"):
        found(spark, [(1, [1e30, 0.0])], **how)


def test_bounds_skip_most_distances():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(-500, 500, (10, 16)), 200, axis=0) + rng.integers(-20, 20, (2000, 16))
    centres, before = x[::200].copy(), None
    cluster, upper, lower = np.zeros(2000, np.int64), np.full(2000, np.inf), np.zeros((2000, 10))
    measured = []
    for _ in range(4):
        cluster, upper, lower, n = clustering.assign(x, cluster, upper, lower, clustering.Centroids(centres, before))
        gaps = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (cluster == gaps.argmin(axis=1)).all()
        assert (upper >= np.sqrt(gaps[np.arange(2000), cluster])).all() and (lower <= np.sqrt(gaps)).all()
        measured.append(n)
        before, centres = centres, np.array([x[cluster == c].sum(axis=0) // max(1, (cluster == c).sum()) for c in range(10)])
    assert measured[-1] < 2000 < measured[0]
