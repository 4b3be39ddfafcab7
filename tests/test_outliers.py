"""Density clusters in any number of dimensions, and random cut trees, against brute force."""

import random

import numpy as np
import pytest

from tracelake.operators import anomaly as X
from tracelake.operators.density import density_clusters


def brute(points, eps, least):
    keys = sorted(points)
    x = np.array([points[k] for k in keys], dtype=float)
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label = {}
    for i, k in enumerate(keys):
        if core[i] and k not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if keys[j] not in label:
                    label[keys[j]] = k
                    todo += [int(m) for m in np.flatnonzero(near[j] & core) if keys[m] not in label]
    out = {}
    for i, k in enumerate(keys):
        out[k] = label.get(k) if core[i] else min((label[keys[m]] for m in np.flatnonzero(near[i] & core)), default=None)
    return out


def cloud(d, n, seed):
    r = random.Random(seed)
    centres = [[r.uniform(0, 6) for _ in range(d)] for _ in range(4)]
    rows = [[c + r.gauss(0, 0.35) for c in r.choice(centres)] if r.random() < 0.8 else [r.uniform(-1, 7) for _ in range(d)] for _ in range(n)]
    rows += [rows[0]] * 12 + [[9.0 + 0.49 * i] + [0.0] * (d - 1) for i in range(12)]  # equal points, and a chain
    return {i: v for i, v in enumerate(rows)}


@pytest.mark.parametrize(("d", "n", "eps", "least", "seed"), [(1, 60, 0.05, 4, 1), (2, 180, 0.3, 5, 2), (4, 160, 0.5, 3, 3)])
def test_density_equals_brute_force(spark, d, n, eps, least, seed):
    points = cloud(d, n, seed)
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in points.items()] + [(9000, *[None] * d), (9001, *[float("nan")] * d)], "id long, " + ", ".join(f"c{i} double" for i in range(d)))
    got = {w.id: w.cluster for w in density_clusters(df, "id", [f"c{i}" for i in range(d)], eps, least).collect()}
    want = brute(points, eps, least) | {9000: None, 9001: None}
    assert got == want and len({v for v in want.values() if v is not None}) > 1


def test_many_equal_points_make_no_pairs(spark):
    df = spark.range(200_000).selectExpr("id", "1.0 as a", "2.0 as b").unionByName(spark.createDataFrame([(200_001, 1.0, 2.45), (200_002, 5.0, 5.0)], "id long, a double, b double"))
    got = {(w.cluster, w["count"]) for w in density_clusters(df, "id", ["a", "b"], 0.5, 5).groupBy("cluster").count().collect()}
    assert got == {(0, 200_001), (None, 1)}


def walk(x, tree, best=0.0):
    """Expected displacement of one point, straight from its definition."""
    n, low, high, f, cut, left, right = tree
    wider = sum(max(lo - v, 0) + max(v - hi, 0) for v, lo, hi in zip(x, low, high, strict=True))
    total = wider + sum(high - low)
    p = wider / total if total else 0.0
    here = p * max(best, n)
    if f is None:
        return here + (1 - p) * best
    side, other = (left, right) if x[f] <= cut else (right, left)
    return here + (1 - p) * walk(x, side, max(best, other[0] / (side[0] + 1)))


def test_displacement_equals_its_definition():
    r = np.random.default_rng(3)
    data = np.concatenate([r.normal(size=(60, 3)), np.repeat(r.normal(size=(1, 3)), 6, axis=0)])
    tree = X.cut_tree(data, r)
    probes = np.concatenate([data[:10], data[-1:], r.normal(size=(40, 3)) * 4])
    assert np.allclose(X.displacement(probes, tree), [walk(p, tree) for p in probes])
    assert X.displacement(data[-1:], X.cut_tree(data[-6:], r)).tolist() == [0.0]

    def check(t):
        n, low, high, f, cut, a, b = t
        if f is not None:
            assert n == a[0] + b[0] and a[2][f] <= cut < b[1][f]
            check(a)
            check(b)

    check(tree)


def test_random_cut_forest_ranks_planted_outliers_first(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(400, 2)))] + [(1000 + k, 9.0 + k, -9.0 - k) for k in range(4)] + [(2000, None, 1.0)]
    out = X.outlier_scores(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], method="rcf").collect()
    assert {w.id for w in sorted((w for w in out if w.score is not None), key=lambda w: -w.score)[:4]} == {1000, 1001, 1002, 1003}
    assert [w.id for w in out if w.score is None] == [2000]


def test_robust_scores_without_keys(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(40)] + [(99, 1000.0)], "id long, v double")
    assert max(X.robust_scores(df, ["v"]).collect(), key=lambda w: w.score).id == 99
    assert X.robust_scores(df.limit(5), ["v"]).count() == 0
