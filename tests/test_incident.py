"""Known patterns as a rule table, retries' amplification, costs and canary scores by hand."""

from tracelake.operators import canary as Y
from tracelake.operators import courses as U
from tracelake.operators import incident as N


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def data(spark):
    spans = rows(spark, [(f"t{i}", "api" if i % 2 else "database", "op", f"2024-01-01 00:00:{i % 60:02d}", 2500.0 if i in (3, 5, 7) else 10.0, i % 3 == 0) for i in range(60)], "trace_id string, service string, operation string, at string, duration_ms double, is_error boolean")
    logs = rows(spark, [("error", "Connection POOL is full"), ("error", "timeout of database"), ("info", "deadlock")], "level string, message string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as ts")
    metrics = rows(spark, [("cpu", 0.5), ("memory", 0.95)], "metric string, value double")
    return spans.selectExpr("*", "cast(at as timestamp_ntz) as start_ts"), logs, metrics


def test_known_patterns_and_rules_of_the_caller(spark):
    seen = {"cpu": "cpu", "memory": "memory"}
    got = {w.pattern: w for w in N.hypotheses(*data(spark), resources=seen).collect()}
    assert set(got) == {"Database connection pool exhaustion", "Memory leak", "Memory exhaustion", "Service failure"}
    assert got["Database connection pool exhaustion"].match == 1.0 and got["Database connection pool exhaustion"].checks == 4
    mine = (("half", "low", "a", "message", "timeout", ">", 0.0, 3.0), ("half", "low", "a", "message", "never", ">", 0.0, 1.0), ("none", "low", "b", "unknown", None, "<", 1.0, 1.0))
    got = {w.pattern: w.match for w in N.pattern_matches(N.observed(*data(spark), rules=mine, resources=seen), N.rule_table(spark, mine)).collect()}
    assert got == {"half": 0.75, "none": 0.0}


def test_amplification_is_a_product_with_a_bound(spark):
    storms = lambda ratios: rows(spark, [("s", float(r), 10, 40, "low") for r in ratios], "service string, ratio double, retries long, requests long, severity string")
    one = N.retry_impact(storms([6, 4, 2.5, 1])).first()
    assert abs(one.amplification - 1.5 * 1.3 * 1.1) < 1e-9 and one.wasted == 80 and one.added_ms == 2300.0
    assert N.retry_impact(storms([6] * 9)).first().amplification == 10.0
    none = N.retry_impact(storms([1]).limit(0)).first()
    assert (none.storms, none.amplification, none.wasted, none.cascading_risk) == (0, 1.0, 0, "low")


def test_costs_and_empty_tables(spark):
    costs = rows(spark, [(i, float(10 + (5 if i >= 7 else 0))) for i in range(14)], "i int, cost double").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(i) as bucket")
    one = U.cost_trend(costs).first()
    assert (one.recent, one.previous, one.change, one.direction) == (15.0, 10.0, 50.0, "increasing")
    assert U.cost_peaks(costs, 2).count() == 2 and U.cost_profile(costs).filter("unit = 'weekday'").count() == 7


def test_canary_scores_only_what_is_significant(spark):
    m = rows(spark, [(100, 100, 300.0, 100.0, 40.0, 0.01, 2.0, 0.01, ["Timeout"], -30.0, 0.2)], "canary_n long, baseline_n long, canary_p99 double, baseline_p99 double, latency_change double, latency_p double, error_change double, error_p double, new_errors array<string>, throughput_change double, throughput_p double")
    parts = {w.part: w.points for w in Y.score_parts(m).collect()}
    assert parts == {"latency": 20.0, "errors": 20.0, "new_errors": 10.0, "throughput": 0.0}
    assert Y.verdict(Y.score_parts(m)).first()[:] == (50.0, "F", "ROLLBACK", "high")
    assert {w.risk for w in Y.risk_factors(m).collect()} == {"latency_tail", "error_cascade", "capacity_degradation"}
