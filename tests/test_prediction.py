"""Failure probabilities that spread along calls, and predictions by hand."""

import pytest

from tracelake.operators import prediction as D


def spread(own, edges, reach, rounds=200):
    total = {}
    for s, _, c in edges:
        total[s] = total.get(s, 0) + c
    p = dict(own)
    for _ in range(rounds):
        new = {}
        for s in own:
            spared = 1.0
            for a, b, c in edges:
                if a == s and b in p:
                    spared *= 1 - reach * c / total[a] * p[b]
            new[s] = 1 - (1 - own[s]) * spared
        p = new
    return p


def frames(spark, own, edges):
    return spark.createDataFrame([(s, float(v)) for s, v in own.items()], "service string, probability double"), spark.createDataFrame(edges, "source string, target string, call_count long")


def test_cascade_is_the_fixed_point(spark):
    own = {"a": 0.0, "b": 0.1, "c": 0.9, "d": 1.0, "e": 0.2}
    edges = [("a", "b", 10), ("b", "c", 5), ("b", "a", 5), ("c", "d", 1), ("d", "a", 3), ("e", "gone", 7)]
    got = {w.service: w.probability for w in D.cascade(*frames(spark, own, edges), reach=0.8).collect()}
    want = spread(own, edges, 0.8)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert got["b"] > own["b"] and got["e"] == pytest.approx(0.2)
    # a callee that fails more makes its caller fail more
    more = {w.service: w.probability for w in D.cascade(*frames(spark, own | {"c": 0.95}, edges), reach=0.8).collect()}
    assert more["b"] > got["b"]
    with pytest.raises(ValueError):
        D.cascade(*frames(spark, own, edges), reach=1.0)


def test_every_kind_of_prediction(spark):
    own = spark.createDataFrame([("x", 0.85, 4, 30), ("y", 0.25, 0, 0), ("z", 0.1, 0, 0)], "service string, probability double, signals long, buckets long")
    moved = spark.createDataFrame([("x", 0.85, 0.85), ("y", 0.25, 0.45), ("z", 0.1, 0.2)], "service string, own double, probability double")
    full = spark.createDataFrame([("disk", 80.0, 90.0, 5.5, "critical"), ("cpu", 10.0, 11.0, None, None)], "metric string, current double, projected double, hours_left double, severity string")
    patterns = spark.createDataFrame([("increasing_failures", None, 0.7, "high")], "pattern string, service string, strength double, severity string")
    peaks = spark.createDataFrame([("hour", 3, 9), ("hour", 22, 8), ("day", 2, 7)], "unit string, value int, count long")
    found = D.predictions(own, moved, full, patterns, peaks, hour_now=22)
    got = {(w.kind, w.service, w.detail): w for w in found.collect()}
    assert set(got) == {("service_failure", "x", None), ("cascading_failure", "y", "callees"), ("resource_exhaustion", None, "disk"), ("cascading_failure", None, "trend"), ("periodic_failure", None, "3:00")}
    assert got["service_failure", "x", None].timeframe == "0-2 hours" and got["service_failure", "x", None].confidence == "high"
    assert got["resource_exhaustion", None, "disk"].probability == 0.9 and got["resource_exhaustion", None, "disk"].timeframe == "5.5 hours"
    assert got["periodic_failure", None, "3:00"].hour == 5
    line = {w.start: (w.probability, w.predictions, w.risk) for w in D.risk_timeline(found).collect()}
    assert line == {0: (0.9, 3, "critical"), 6: (0.6, 2, "high"), 12: (0.0, 0, "low"), 18: (0.0, 0, "low")}


def test_minutes_of_warnings(spark):
    rows = [(f"t{i}-{k}", "s", f"2024-01-01 00:{10 * (i // 6) % 60:02d}:0{i % 6}", 100.0 + (400.0 if i >= 30 and k == 0 else 0.0), i >= 30 and k < 4) for i in range(36) for k in range(5)]
    spans = spark.createDataFrame(rows, "trace_id string, service string, ts string, duration_ms double, is_error boolean").selectExpr("*", "cast(ts as timestamp_ntz) as start_ts")
    got = {w.signal: w for w in D.warning_signals(spans, 600, "low").collect()}
    assert got == {}  # a baseline without any spread scores nothing
    spans = spans.unionByName(spans.limit(1).selectExpr("'u' as trace_id", "service", "ts", "130.0 as duration_ms", "true as is_error", "start_ts"))
    got = {w.signal: w for w in D.warning_signals(spans, 600, "low").collect()}
    assert got["error_rate_anomaly"].severity == "high" and abs(got["error_rate_anomaly"].value - 80.0) < 1e-9
