"""Hand-made fixtures and invariants."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.functions import timeutil as U
from tracelake.operators import anomaly as X
from tracelake.operators import graph as G
from tracelake.operators import histogram as H
from tracelake.operators import reports as P
from tracelake.operators import series as R
from tracelake.operators import trees as T
from tracelake.sources import io

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("t", "A", None, "gateway", "a", T0, 100.0, False, None), ("t", "B", "A", "svc-1", "b", T0, 60.0, False, None), ("t", "C", "A", "svc-3", "c", T0, 80.0, False, None), ("t", "D", "B", "svc-2", "d", T0, 50.0, True, "E")]
    return spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service string, operation string, start_ts timestamp_ntz, duration_ms double, is_error boolean, error_type string")


def test_critical_path_takes_the_largest_sum(tree):
    assert T.critical_paths(tree, 5).first()["path"] == ["A", "B", "D"]


def test_edges(tree):
    assert {(r.source, r.target) for r in G.dependency_edges(tree).collect()} == {("gateway", "svc-1"), ("svc-1", "svc-2"), ("gateway", "svc-3")}
    assert {(r.source, r.target) for r in G.dependency_edges(tree, root_edges=False).collect()} == {("svc-1", "svc-2")}


def test_cycles_end(spark):
    rows = [("t", "A", "B", "x", "o", T0, 1.0, True, "E"), ("t", "B", "A", "y", "o", T0, 1.0, True, "E"), ("t", "S", "S", "z", "o", T0, 1.0, False, None)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service string, operation string, start_ts timestamp_ntz, duration_ms double, is_error boolean, error_type string")
    assert {r.span_id for r in T.span_paths(df, 5).collect()} == {"S"}
    assert {r.length for r in T.error_chains(df, "upstream", 5).collect()} == {2}


def points(spark, values):
    return spark.createDataFrame([("s", i, T0 + timedelta(minutes=i), float(v)) for i, v in enumerate(values)], "k string, i int, ts timestamp_ntz, value double")


def test_one_spike(spark):
    s = points(spark, [10.0] * 14 + [100.0] + [10.0] * 15)
    assert [r.i for r in X.z_anomalies(s, ["k"], 0.95).collect()] == [14]
    assert X.mad_anomalies(s, ["k"]).count() == 0  # its MAD is 0


def test_forecast_band_holds_the_point(spark):
    for r in R.forecast(points(spark, range(20)), ["k"], 5).collect():
        assert r.lower <= r.forecast <= r.upper and abs(r.forecast - (19 + r.k)) < 1e-9


def test_equal_histograms_do_not_differ(spark):
    h = spark.createDataFrame([(0.0, 5), (1.0, 5)], "key double, count long")
    d = H.divergences(h, h).first()
    assert (d.kl, d.js, d.wasserstein) == (0.0, 0.0, 0.0)
    far = H.divergences(h, spark.createDataFrame([(5.0, 10)], "key double, count long")).first()
    assert far.kl == 0.0 and far.bhattacharyya == float("inf") and far.js <= 0.6932


def test_pagerank_of_a_cycle_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    assert abs(sum(r["rank"] for r in G.pagerank(e).collect()) - 1) < 1e-9


def test_template_order(spark):
    df = spark.createDataFrame([("user 42 from 10.0.0.1 id 550e8400-e29b-41d4-a716-446655440000",)], "m string")
    assert df.select(C.template_a(F.col("m"))).first()[0] == "user {NUMBER} from {NUMBER}.{NUMBER} id {UUID}"


def test_one_violation_of_two_buckets(spark):
    rows = [("s", T0 + timedelta(hours=h), h in (3, 4) and k < 50) for h in range(10) for k in range(100)]
    df = spark.createDataFrame(rows, "service string, start_ts timestamp_ntz, is_error boolean")
    v = P.violations(df, 3600, 99.0).collect()
    assert len(v) == 1 and v[0].length == 2 and v[0].requests == 200


def test_times():
    assert U.interval_seconds("90s") == 90 and U.interval_seconds("x") == 300
    assert U.resolve_time("now-1M", T0) == T0 - timedelta(days=30)
    with pytest.raises(ValueError):
        U.resolve_range("now", "now-1h", T0)


def test_spellings_are_normalised(spark):
    df = spark.createDataFrame([("t", "s", "s", "svc", 1500.0, 2, "x")], "traceId string, spanId string, parentSpanId string, `service.name` string, duration double, `status.code` int, region string")
    r = io.normalize_spans(df, "us").first()
    assert (r.trace_id, r.parent_span_id, r.service, r.duration_ms, r.is_error, r.attributes) == ("t", None, "svc", 1.5, True, {"region": "x"})
    r = io.normalize_logs(spark.createDataFrame([("m", 7)], "Body string, code int")).first()
    assert (r.level, r.message, r.attributes) == ("info", "m", {"code": "7"})


def test_same_rows_whatever_the_partitions(spark, tree):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = sorted(map(str, G.dependency_edges(tree).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == sorted(map(str, G.dependency_edges(tree.repartition(4)).collect()))
