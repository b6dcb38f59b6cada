"""Links of vectors by cap filters against all pairs."""

import numpy as np
import pytest

from newsloom.llm import cap_filters

SCHEMA = "vec_id long, embedding array<double>, label int, row long, ent long, cell int, u string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, 2, 3, "u") for i, e in rows], SCHEMA)


def brute(rows):
    """(vec_id, n_links, component_id, kept) of every row, sorted."""
    dim = max((len(e) for _, e in rows if e), default=1)
    units = np.full((len(rows), dim), np.nan)
    for i, (_, e) in enumerate(rows):
        if e and all(c is not None and np.isfinite(c) for c in e) and any(e):
            x = np.array([*e, *[0.0] * (dim - len(e))])
            x /= np.abs(x).max()
            units[i] = x / np.linalg.norm(x)
    link = units @ units.T >= 0.9
    np.fill_diagonal(link, False)
    least = [r[0] for r in rows]
    of = list(range(len(rows)))
    for i, j in zip(*link.nonzero(), strict=True):
        if of[i] != of[j]:
            old, new = of[j], of[i]
            of = [new if x == old else x for x in of]
    out = []
    for i in range(len(rows)):
        component = min((least[j] for j in range(len(rows)) if of[j] == of[i] and least[j] is not None), default=None)
        out.append((least[i], int(link[i].sum()), component, least[i] == component))
    return sorted(out, key=str)


def found(spark, rows, **how):
    return sorted((tuple(r) for r in cap_filters.near_duplicates(table_of(spark, rows), **how).collect()), key=str)


def near(rng, point, n, angle):
    """n vectors about that angle from a point, of different lengths."""
    away = rng.normal(size=(n, len(point)))
    away -= np.outer(away @ point, point) / (point @ point)
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    spread = rng.uniform(0, angle, n)
    return (np.outer(np.cos(spread), point / np.linalg.norm(point)) + np.sin(spread)[:, None] * away) * rng.uniform(0.1, 10, n)[:, None]


@pytest.mark.parametrize("how", [{}, {"block": 16, "members": 5}])
def test_groups_balls_and_odd_rows(spark, how):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(6, 32))
    # tight and wide groups, one whose members are partly linked, one beside a tight one
    vectors = [v for p, n, a in zip(points, (60, 5, 40, 2, 30, 9), (0.05, 0.1, 0.5, 0.2, 0.3, 0.02), strict=True) for v in near(rng, p, n, a)]
    vectors += [*near(rng, points[0] + 0.42 * np.linalg.norm(points[0]) * points[1] / np.linalg.norm(points[1]), 25, 0.06), *rng.normal(size=(60, 32))]
    rows = [(3 * i + 5, v.tolist()) for i, v in enumerate(vectors)] + [(900 + i, vectors[0].tolist()) for i in range(20)]
    rows += [(4, vectors[1].tolist()), (4, vectors[100].tolist()), (None, vectors[2].tolist()), (None, None), (1000, None), (1001, []), (1002, [0.0] * 32),
             (1003, [float("nan")] * 32), (1004, [None, *[1.0] * 31]), (1005, [float("inf"), *[1.0] * 31]), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]),
             (1008, [1e300] * 32), (1009, [1e-300] * 32)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    true, ours = brute(rows), found(spark, rows, recall=0.999, **how)
    assert ours == true


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = rng.normal(size=a.shape)
    away -= (a * away).sum(axis=1, keepdims=True) * a
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    b = 0.902 * a + np.sqrt(1 - 0.902**2) * away
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    ours = found(spark, rows)
    assert 0.9 * 3000 <= sum(r[1] for r in ours) <= 3000
    assert all(r[1] <= 1 and r[2] in (r[0], r[0] - 1500) for r in ours)


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1, True)]
    assert found(spark, [(2, [0.5])]) == [(2, 0, 2, True)]


def test_decoding_finds_every_filter():
    rng = np.random.default_rng(1)
    codes = cap_filters.ProductCodes(10, 60, codes=2, parts=3)
    units = rng.normal(size=(50, 10))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    at, filt = codes.decode(units, 0.3, rows=7)
    every = set()
    for code in range(2):
        inner = codes._inner(units, code)
        for v in range(50):
            for k in range(codes.size**3):
                c = (k // codes.size**2, k // codes.size % codes.size, k % codes.size)
                if sum(inner[p, v, c[p]] for p in range(3)) >= 0.3:
                    every.add((v, code * codes.size**3 + k))
    assert set(zip(at.tolist(), filt.tolist(), strict=True)) == every and len(at) == len(every)
