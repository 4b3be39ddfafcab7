"""Operators that SQL can't express, against brute force over small data."""

import itertools
import random

import numpy as np

from tracelake.operators import anomaly, logtext, vectors


def test_pca_scores_are_reconstruction_errors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 4)) @ r.normal(size=(4, 4)) + r.normal(size=4)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, a double, b double, c double, d double")
    got = {w.id: w.score for w in anomaly.pca_scores(df, ["a", "b", "c", "d"], 2).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    top = np.linalg.eigh(np.cov(z.T))[1][:, -2:]
    want = np.sqrt(((z - z @ top @ top.T) ** 2).sum(axis=1))
    assert all(abs(got[i] - want[i]) < 1e-6 for i in range(len(x)))


def test_isolation_forest_ranks_planted_outliers_first(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(400, 2)))] + [(1000 + k, 9.0 + k, -9.0 - k) for k in range(4)]
    out = anomaly.isolation_forest(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"]).collect()
    assert {w.id for w in sorted(out, key=lambda w: -w.score)[:4]} == {1000, 1001, 1002, 1003}


def test_prefix_sequences(spark):
    r = random.Random(6)
    events = [(k, t, r.choice("abc")) for k in range(12) for t in range(r.randrange(1, 6))]
    df = spark.createDataFrame(events, "k long, t long, item string")
    of = {}
    for k, t, x in sorted(events):
        of.setdefault(k, []).append(x)

    def holds(seq, s):
        it = iter(seq)
        return all(x in it for x in s)

    want = {}
    for n in (1, 2, 3):
        for s in itertools.product("abc", repeat=n):
            c = sum(holds(v, s) for v in of.values())
            if c >= 0.4 * len(of):
                want[" > ".join(s)] = c
    assert {w["sequence"]: w["count"] for w in logtext.prefix_sequences(df, ["k"], "item", "t", 0.4).collect()} == want


def test_similar_pairs_recall(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (v + r.normal(size=16) * 0.15).tolist()) for i, v in enumerate(base)]
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(x), 2) if x[a] @ x[b] >= 0.8}
    out = vectors.similar_pairs(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.8)
    a, b = out.columns[:2]
    got = {tuple(sorted((w[a], w[b]))) for w in out.collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 30
