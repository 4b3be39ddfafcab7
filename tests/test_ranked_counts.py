"""Percentiles of groups from ranges of their values, against Spark's own and brute force."""

import math
import random

from pyspark.sql import functions as F

from tracelake.functions import stats
from tracelake.operators import anomaly, graph

_SCHEMA = "k string, v double"


def grouped(spark):
    rng = random.Random(5)
    rows = [("a", rng.choice([rng.random() * 1000, 7.0, -3.5])) for _ in range(3000)] + [("b", float(i % 3)) for i in range(500)] + [(None, 2.5), (None, 4.0), ("one", 9.0), ("none", None), ("a", None)]
    return spark.createDataFrame(rows, _SCHEMA), rows


def test_interpolated_from_ranges(spark, monkeypatch):
    df, _ = grouped(spark)
    points = {"lo": 0.0, "q": 0.25, "m": 0.5, "p": 0.95, "hi": 1.0}
    want = {r.k: r for r in df.filter("v is not null").groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in points.items()]).collect()}
    for most in (10**6, 0):
        monkeypatch.setattr(stats, "MOST_RANKED", most)
        got = {r.k: r for r in stats.interpolated_percentiles(df, ["k"], "v", points).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert all(math.isclose(got[k][n], want[k][n], rel_tol=1e-12) for n in points)
        whole = stats.interpolated_percentiles(df, [], "v", {"m": 0.5}).first()["m"]
        assert math.isclose(whole, df.agg(F.percentile("v", F.lit(0.5)).alias("m")).first()["m"])


def test_ranks_from_ranges(spark, monkeypatch):
    monkeypatch.setattr(stats, "MOST_RANKED", 0)
    df, rows = grouped(spark)
    got = {r.k: r for r in stats.rank_percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.99}).collect()}
    for k in ("a", "b", None, "one"):
        v = sorted(x for g, x in rows if g == k and x is not None)
        assert all(got[k][n] == v[max(math.ceil(p * len(v)), 1) - 1] for n, p in (("m", 0.5), ("p", 0.99)))


def test_no_group_in_one_task(spark):
    """Neither percentile states of a group nor a window over its rows."""
    df, _ = grouped(spark)
    for out in (stats.interpolated_percentiles(df, ["k"], "v", {"m": 0.5}), anomaly.robust_scores(df, ["v"], ["k"], least=1)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan
    assert "Window" not in anomaly.robust_scores(df, ["v"], ["k"], least=1)._jdf.queryExecution().optimizedPlan().toString()


def test_edges_read_their_counts(spark):
    rows = [("t", "a", None, "x", 5.0, False), ("t", "b", "a", "y", 10.0, True), ("t", "c", "a", "y", 10.0, False), ("t", "d", "a", "y", None, False), ("t", "e", "a", "z", None, True)]
    e = graph.dependency_edges(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service string, duration_ms double, is_error boolean"))
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "parent_span_id" not in plan  # spans are joined once, however often edges are used
    got = {(r.source, r.target): r for r in e.collect()}
    assert (got["x", "y"].call_count, got["x", "y"].error_count, got["x", "y"].lat_avg, got["x", "y"].lat_p95) == (3, 1, 10.0, 10.0)
    assert (got["x", "z"].call_count, got["x", "z"].error_count, got["x", "z"].lat_avg, got["x", "z"].lat_p95) == (1, 1, None, None)
