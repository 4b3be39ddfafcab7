"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import anomaly as X
from tracelake.operators import graph as G
from tracelake.operators import reports as P
from tracelake.operators import series as R
from tracelake.plans.fixtures import LOGS, METRICS, SPANS, logs, metrics, spans
from tracelake.plans.registry import query

_CALLS = f"{SPANS}, calls AS (SELECT c.*, p.service AS source, c.service AS target FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.service <> c.service)"


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


_SLI = f"""{SPANS}, sl AS (SELECT service, 'availability' AS slo, (count(DISTINCT trace_id) - count(DISTINCT CASE WHEN is_error THEN trace_id END)) * 100.0 / count(DISTINCT trace_id) AS actual, count(*) AS volume, 99.9 AS target FROM spans GROUP BY service
UNION ALL SELECT service, 'latency', count(*) FILTER (WHERE duration_ms <= 500) * 100.0 / count(*), count(*), 95.0 FROM spans GROUP BY service UNION ALL SELECT service, 'error_rate', 100 - count(*) FILTER (WHERE is_error) * 100.0 / count(*), count(*), 99.0 FROM spans GROUP BY service)"""
_KINDS = {k: v for k, v in P.TARGETS.items() if k != "throughput"}


def slis(spark, sf):
    return P.sli_set(spans(spark, sf), _KINDS)


@query("b1_b3_b5_cp15_sli", f"WITH {_SLI} SELECT service, slo, round(actual, 4) AS actual, volume, CAST(target AS DOUBLE) AS target, actual >= target AS met, round(least(actual * 100 / target, 100.0), 4) AS compliance FROM sl")
def _(spark, sf):
    return rounded(slis(spark, sf), "actual", "compliance")


@query("b4_throughput_sli", f"WITH {SPANS}, b AS (SELECT service, time_bucket(INTERVAL '1 minute', start_ts) AS b, count(*) AS n FROM spans GROUP BY ALL) SELECT service, round(count(*) FILTER (WHERE n >= 3) * 100.0 / count(*), 4) AS actual, CAST(sum(n) AS BIGINT) AS volume FROM b GROUP BY service")
def _(spark, sf):
    return rounded(P.sli(spans(spark, sf), "throughput", per_minute=3), "actual")


@query("b6_error_budget", f"WITH {_SLI} SELECT service, slo, round(volume * (100 - target) / 100, 4) AS budget, round(volume * (100 - actual) / 100, 4) AS consumed, CASE WHEN (100 - actual) / (100 - target) >= 1 THEN 'exhausted' WHEN (100 - actual) / (100 - target) >= 0.8 THEN 'critical' WHEN (100 - actual) / (100 - target) >= 0.6 THEN 'warning' ELSE 'healthy' END AS status FROM sl")
def _(spark, sf):
    return rounded(P.error_budget(slis(spark, sf), 24).select("service", "slo", "budget", "consumed", "status"), "budget", "consumed")


@query("b7_violations", f"""WITH {SPANS}, b AS (SELECT service, time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS bucket, 100 - count(*) FILTER (WHERE is_error) * 100.0 / count(*) AS actual, count(*) AS requests FROM spans GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY bucket) AS i FROM b), g AS (SELECT *, i - row_number() OVER (PARTITION BY service ORDER BY bucket) AS k FROM r WHERE actual < 85)
SELECT service, min(bucket) AS first, max(bucket) AS last, count(*) AS length, CAST(sum(requests) AS BIGINT) AS requests, round(max(85 - actual), 4) AS miss FROM g GROUP BY service, k""")
def _(spark, sf):
    return rounded(P.violations(spans(spark, sf), 30 * 86400, 85.0).drop("severity"), "miss")


@query("b8_projection", f"WITH {_SLI} SELECT service, slo, round(greatest(0.0, least(actual * 100 / target, 100.0) - 2.4), 4) AS projected FROM sl")
def _(spark, sf):
    return rounded(P.compliance_projection(slis(spark, sf)).select("service", "slo", "projected"), "projected")


@query("b9_risk", f"WITH {_SLI}, x AS (SELECT service, slo, actual, target, (100 - actual) * 100 / (100 - target) AS c FROM sl), s AS (SELECT service, slo, CASE WHEN actual < target THEN 30 WHEN actual - target < 0.5 THEN 20 ELSE 0 END + CASE WHEN c >= 100 THEN 40 WHEN c >= 80 THEN 30 WHEN c >= 60 THEN 20 ELSE 0 END + CASE WHEN c / 24 > 5 THEN 25 ELSE 0 END AS risk FROM x) SELECT service, slo, risk, CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 30 THEN 'medium' ELSE 'low' END AS level FROM s")
def _(spark, sf):
    s = slis(spark, sf)
    return P.slo_risk(s, P.error_budget(s, 24))


@query("b10_overall", f"WITH {_SLI} SELECT round(sum(least(actual * 100 / target, 100.0) * volume) / sum(volume), 4) AS compliance FROM sl")
def _(spark, sf):
    return rounded(P.overall_compliance(slis(spark, sf)), "compliance")


@query("c1_c2_c4_canary", f"""WITH {SPANS}, a AS (SELECT count(*) AS n, avg(duration_ms) AS m, var_samp(duration_ms) AS v, count(*) FILTER (WHERE is_error) AS e FROM spans WHERE service = 'svc-0'), b AS (SELECT count(*) AS n, avg(duration_ms) AS m, var_samp(duration_ms) AS v, count(*) FILTER (WHERE is_error) AS e FROM spans WHERE service = 'svc-1')
SELECT true AS valid, a.n AS canary_n, b.n AS baseline_n, round((a.m - b.m) / b.m * 100, 5) AS latency_change, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS t, round((a.e * 1.0 / a.n - b.e * 1.0 / b.n) / sqrt(((a.e + b.e) * 1.0 / (a.n + b.n)) * (1 - (a.e + b.e) * 1.0 / (a.n + b.n)) * (1.0 / a.n + 1.0 / b.n)), 5) AS z FROM a, b""")
def _(spark, sf):
    return rounded(P.canary_compare(spans(spark, sf), "svc-0", "svc-1").select("valid", "canary_n", "baseline_n", "latency_change", "t", "z"), "latency_change", "t", "z", digits=5)


_STEP = "CASE WHEN abs({0}) > 3.291 THEN 0.001 WHEN abs({0}) > 2.576 THEN 0.01 WHEN abs({0}) > 1.96 THEN 0.05 WHEN abs({0}) > 1.645 THEN 0.1 ELSE 0.2 END"
_GRADE = "CASE " + " ".join(f"WHEN score >= {least} THEN '{name}'" for least, name in P.GRADES) + " ELSE 'F' END"


@query("c4_canary_score", f"""WITH {SPANS}, a AS (SELECT count(*) AS n, avg(duration_ms) AS m, var_samp(duration_ms) AS v, count(*) FILTER (WHERE is_error) AS e FROM spans WHERE service = 'svc-0'), b AS (SELECT count(*) AS n, avg(duration_ms) AS m, var_samp(duration_ms) AS v, count(*) FILTER (WHERE is_error) AS e FROM spans WHERE service = 'svc-1'),
n AS (SELECT count(*) AS new_errors FROM (SELECT DISTINCT error_type FROM spans WHERE service = 'svc-0' AND error_type IS NOT NULL EXCEPT SELECT error_type FROM spans WHERE service = 'svc-1')),
x AS (SELECT new_errors, (a.m - b.m) / b.m * 100 AS lc, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, a.e * 100.0 / a.n - b.e * 100.0 / b.n AS ec, (a.e * 1.0 / a.n - b.e * 1.0 / b.n) / sqrt(((a.e + b.e) * 1.0 / (a.n + b.n)) * (1 - (a.e + b.e) * 1.0 / (a.n + b.n)) * (1.0 / a.n + 1.0 / b.n)) AS z FROM a, b, n),
y AS (SELECT *, {_STEP.format('t')} AS latency_p, {_STEP.format('z')} AS error_p FROM x), w AS (SELECT *, 100 - CASE WHEN latency_p <= 0.05 THEN least(greatest(lc, 0), 30) ELSE 0 END - CASE WHEN error_p <= 0.05 THEN least(greatest(ec * 10, 0), 40) ELSE 0 END - least(new_errors * 5, 20) AS score FROM y)
SELECT round(score, 4) AS score, {_GRADE} AS grade, CAST(latency_p AS DOUBLE) AS latency_p, CAST(error_p AS DOUBLE) AS error_p, CAST(new_errors AS INT) AS new_errors FROM w""")
def _(spark, sf):
    return rounded(P.canary_compare(spans(spark, sf), "svc-0", "svc-1").select("score", "grade", "latency_p", "error_p", "new_errors"), "score")


@query("c3_error_comparison", f"WITH {SPANS}, r AS (SELECT service, error_type, count(*) AS c FROM spans WHERE is_error AND service IN ('svc-0', 'svc-1') GROUP BY ALL), n AS (SELECT service, count(*) AS n FROM spans GROUP BY service), p AS (SELECT service, error_type, c * 100.0 / n AS p FROM r JOIN n USING (service)) SELECT error_type, round(max(p) FILTER (WHERE service = 'svc-0'), 5) AS canary, round(max(p) FILTER (WHERE service = 'svc-1'), 5) AS baseline FROM p GROUP BY error_type")
def _(spark, sf):
    return rounded(P.error_comparison(spans(spark, sf), "svc-0", "svc-1").drop("state"), "canary", "baseline", digits=5)


_REG = f"""WITH {SPANS}, k AS (SELECT unnest(range(0, 8)) AS k), r AS (SELECT service, operation, k, quantile_cont(duration_ms, 0.95) AS p95, 100 - count(*) FILTER (WHERE is_error) * 100.0 / count(*) AS ok FROM spans, k WHERE start_ts >= TIMESTAMP '1996-06-01 00:00:00' - k * INTERVAL '30 days' AND start_ts < TIMESTAMP '1996-07-01 00:00:00' - k * INTERVAL '30 days' GROUP BY ALL),
b AS (SELECT service, operation, avg(p95) AS m, stddev_pop(p95) AS s, avg(ok) AS bok FROM r WHERE k > 0 GROUP BY ALL)"""


def regressions(spark, sf):
    return P.regressions(spans(spark, sf), "1996-06-01 00:00:00", "1996-07-01 00:00:00", 7, 30)


@query("k1_k2_regressions", _REG + " SELECT r.service, r.operation, round(p95, 4) AS p95, round(m, 4) AS mean, round(bok - ok, 4) AS success_drop FROM r JOIN b USING (service, operation) WHERE k = 0")
def _(spark, sf):
    return rounded(regressions(spark, sf).select("service", "operation", "p95", "mean", "success_drop"), "p95", "mean", "success_drop")


@query("k3_k5_regression_patterns", _REG + ", f AS (SELECT r.service FROM r JOIN b USING (service, operation) WHERE k = 0 AND ((s > 0 AND (p95 - m) / s > 2.5) OR (ok < 99 AND bok - ok > 1))) SELECT service, count(*) AS operations, count(*) >= 2 AS concentrated FROM f GROUP BY service")
def _(spark, sf):
    return P.regression_patterns(regressions(spark, sf)).select("service", "operations", "concentrated")


@query("k4_traffic_spikes", f"WITH {SPANS}, b AS (SELECT service, time_bucket(INTERVAL '7 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS b, count(*) AS n FROM spans GROUP BY ALL) SELECT service, max(n) AS peak, round(avg(n), 4) AS mean, max(n) > 2 * avg(n) AS spike FROM b GROUP BY service")
def _(spark, sf):
    return rounded(P.traffic_spikes(spans(spark, sf), 7 * 86400), "mean")


def retry():
    return F.col("line") > 4


@query("q1_q5_retry_storms", f"""WITH {SPANS}, g AS (SELECT service, count(*) AS requests, count(DISTINCT trace_id) AS traces, count(*) FILTER (WHERE line > 4) AS retries, count(*) FILTER (WHERE error_type = 'Timeout') AS timeouts FROM spans GROUP BY ALL)
SELECT service, requests, traces, retries, timeouts, round(requests / CAST(traces AS DOUBLE), 6) AS ratio, retries * 2 AS wasted FROM g WHERE requests >= 100 AND requests / CAST(traces AS DOUBLE) >= 1.1""")
def _(spark, sf):
    out = P.retry_storms(spans(spark, sf), retry(), ["service"], 100, 1.1, 86400)
    return rounded(out.select("service", "requests", "traces", "retries", "timeouts", "ratio", "wasted"), "ratio", digits=6)


@query("q2_q3_retry_shape", f"WITH {SPANS}, b AS (SELECT service, time_bucket(INTERVAL '90 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS bucket, count(*) AS n FROM spans WHERE line > 4 GROUP BY ALL) SELECT service, count(*) AS points, round(stddev_pop(n) / avg(n), 6) AS cv FROM b GROUP BY service")
def _(spark, sf):
    b = spans(spark, sf).filter(retry()).groupBy("service", F.window("start_ts", "90 days")["start"].alias("bucket")).agg(F.count("*").alias("n"))
    return rounded(P.retry_shape(b, ["service"]).select("service", "points", "cv"), "cv", digits=6)


@query("q4_retry_causes", f"WITH {SPANS}, p AS (SELECT service, error_type, count(*) AS n FROM spans WHERE line > 4 AND is_error GROUP BY ALL) SELECT service, arg_max(error_type, struct_pack(a := n, b := error_type)) AS cause, max(n) AS n FROM p GROUP BY service")
def _(spark, sf):
    return P.retry_causes(spans(spark, sf), retry()).select("service", "cause", "n")


@query("q6_retry_cascades", f"WITH {_CALLS} SELECT source, target, count(*) AS calls, round(count(*) FILTER (WHERE line > 4) / CAST(count(*) AS DOUBLE), 6) AS retry_rate FROM calls GROUP BY ALL HAVING count(*) FILTER (WHERE line > 4) / CAST(count(*) AS DOUBLE) > 0.2")
def _(spark, sf):
    return rounded(P.retry_cascades(spans(spark, sf), retry()).drop("amplification"), "retry_rate", digits=6)


_COST = f"""{SPANS}, c AS (SELECT service, count(*) AS requests, avg(duration_ms) AS avg, sum(duration_ms) / 3600000 * 0.2 + count(*) * 1024 / 1e9 * 0.01 + count(*) / 1e6 * 0.2 + 0.01 / 720 * 24 AS cost FROM spans GROUP BY service)"""


@query("v1_v2_cost", f"WITH {_COST} SELECT service, requests, round(cost, 6) AS cost, round(cost * 100 / sum(cost) OVER (), 4) AS share, round(cost / 24 * 720, 4) AS monthly FROM c")
def _(spark, sf):
    return rounded(rounded(P.cost_by(spans(spark, sf)).select("service", "requests", "cost", "share", "monthly"), "cost", digits=6), "share", "monthly")


@query("v3_v6_cost_over_time", f"WITH {SPANS}, b AS (SELECT time_bucket(INTERVAL '7 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS bucket, sum(duration_ms) / 3600000 * 0.2 AS cost FROM spans GROUP BY 1) SELECT bucket, round(cost, 6) AS cost, round(cost / (SELECT avg(cost) FROM b), 4) AS factor FROM b")
def _(spark, sf):
    return rounded(rounded(P.cost_over_time(spans(spark, sf), 7 * 86400).drop("spike"), "cost", digits=6), "factor")


@query("v4_expensive_operations", f"WITH {SPANS} SELECT service, operation, round(sum(duration_ms) / 3600000 * 0.1, 6) AS compute FROM spans GROUP BY ALL ORDER BY sum(duration_ms) DESC, service, operation LIMIT 20")
def _(spark, sf):
    c = P.cost_by(spans(spark, sf), ["service", "operation"]).orderBy(F.desc("compute"), "service", "operation").limit(20)
    return rounded(c.select("service", "operation", "compute"), "compute", digits=6)


@query("v5_savings", f"WITH {_COST} SELECT service, 'optimise' AS kind, round(cost * 0.5, 6) AS saving FROM c WHERE avg > 1000 UNION ALL SELECT service, 'cache', round(cost * 0.4, 6) FROM c WHERE cost * 100 / (SELECT sum(cost) FROM c) > 20")
def _(spark, sf):
    s = P.cost_savings(P.cost_by(spans(spark, sf)), "service").filter("kind in ('optimise', 'cache')")
    return rounded(s, "saving", digits=6)


def stages(spark, sf):
    return P.pipeline_health(logs(spark, sf).withColumn("stage", F.concat(F.lit("stage-"), (F.col("user_id") % 5).cast("string"))), ["stage"], "value", F.col("level") != "error", 720.0, 60.0)


_STAGE = f"WITH {LOGS}, s AS (SELECT concat('stage-', user_id % 5) AS stage, ts, value, level FROM logs), h AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ts, value) <= floor(count(*) OVER (PARTITION BY stage) / 2) AS h FROM s)"


@query("y1_y2_pipeline_health", _STAGE + " SELECT stage, count(*) AS events, round(avg(value), 4) AS avg, round(count(*) FILTER (WHERE level = 'error') * 100.0 / count(*), 4) AS error_rate, CASE WHEN avg(value) FILTER (WHERE NOT h) / avg(value) FILTER (WHERE h) - 1 > 0.1 THEN 'degrading' WHEN avg(value) FILTER (WHERE NOT h) / avg(value) FILTER (WHERE h) - 1 < -0.1 THEN 'improving' ELSE 'stable' END AS trend FROM h GROUP BY stage")
def _(spark, sf):
    return rounded(stages(spark, sf).select("stage", "events", "avg", "error_rate", "trend"), "avg", "error_rate")


@query("y3_data_flow", f"WITH {LOGS}, b AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket, count(*) AS i, count(*) FILTER (WHERE level <> 'error') AS o FROM logs GROUP BY 1) SELECT bucket, i AS records_in, o AS records_out, i > 1.2 * o AS backlog, i > 3 * (SELECT avg(i) FROM b) AS burst FROM b")
def _(spark, sf):
    return P.data_flow(logs(spark, sf), 21600, F.lit(1), (F.col("level") != "error").cast("int"))


@query("y4_stage_bottlenecks", _STAGE + " SELECT stage, 'failing' AS issues FROM h GROUP BY stage HAVING count(*) FILTER (WHERE level = 'error') * 100.0 / count(*) > 10")
def _(spark, sf):
    return P.stage_bottlenecks(stages(spark, sf)).select("stage", "issues")


@query("y5_data_quality", f"WITH {LOGS} SELECT count(*) AS total, round(count(*) FILTER (WHERE level <> 'error') * 100.0 / count(*), 4) AS valid, round(count(*) FILTER (WHERE level = 'warn') * 100.0 / count(*), 4) AS warnings, round(avg(value), 4) AS score_mean, round(stddev_pop(value), 4) AS score_std, count(DISTINCT event_id) AS distinct FROM logs")
def _(spark, sf):
    return rounded(P.data_quality(logs(spark, sf), "event_id", F.col("level") != "error", F.col("level") == "warn", F.col("value")), "valid", "warnings", "score_mean", "score_std")


@query("y6_pipeline_score", _STAGE + f", g AS (SELECT stage, count(*) FILTER (WHERE level = 'error') * 100.0 / count(*) AS e, avg(value) > 60 AS slow, count(*) / 43200.0 < 100 AS starved FROM h GROUP BY stage), w AS (SELECT greatest(0, 100 - avg(e) * 5 - count(*) FILTER (WHERE slow) * 100.0 / count(*) * 0.2 - count(*) FILTER (WHERE starved) * 100.0 / count(*) * 0.1) AS score FROM g) SELECT round(score, 4) AS score, {_GRADE} AS grade FROM w")
def _(spark, sf):
    return rounded(P.pipeline_score(stages(spark, sf)), "score")


_DEP = f"""WITH {SPANS}, g AS (SELECT service, count(*) AS calls, count(*) FILTER (WHERE is_error) * 100.0 / count(*) AS e, quantile_cont(duration_ms, 0.95) AS p95 FROM spans GROUP BY service), b AS (SELECT service, time_bucket(INTERVAL '1 day', start_ts) AS b, count(*) FILTER (WHERE NOT is_error) / CAST(count(*) AS DOUBLE) AS ok FROM spans GROUP BY ALL), a AS (SELECT service, count(*) FILTER (WHERE ok >= 0.95) * 100.0 / count(*) AS availability FROM b GROUP BY service)"""


@query("d1_d2_dependency_health", _DEP + " SELECT service, calls, round(e, 4) AS error_rate, round(p95, 4) AS p95, round(availability, 4) AS availability FROM g JOIN a USING (service)")
def _(spark, sf):
    return rounded(P.dependency_health(spans(spark, sf), 86400).select("service", "calls", "error_rate", "p95", "availability"), "error_rate", "p95", "availability")


@query("d4_dependency_score", _DEP + " SELECT service, round(greatest(0.0, 100 - least(2 * e, 40.0) - CASE WHEN p95 > 1000 THEN 30 WHEN p95 > 500 THEN 15 ELSE 0 END - (100 - availability) * 0.3), 4) AS score FROM g JOIN a USING (service)")
def _(spark, sf):
    return rounded(P.dependency_health(spans(spark, sf), 86400).select("service", "score"), "score")


@query("d3_correlated_failures", f"""WITH {SPANS}, p AS (SELECT service, time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS b, count(*) AS n FROM spans WHERE is_error GROUP BY ALL), e AS (SELECT s.service, t.b, coalesce(p.n, 0) AS n FROM (SELECT DISTINCT service FROM p) s CROSS JOIN (SELECT DISTINCT b FROM p) t LEFT JOIN p ON p.service = s.service AND p.b = t.b)
SELECT a.service AS x, c.service AS y, round(corr(a.n, c.n), 5) AS r FROM e a JOIN e c ON a.b = c.b AND a.service < c.service GROUP BY ALL HAVING corr(a.n, c.n) >= 0.5""")
def _(spark, sf):
    return rounded(P.correlated_failures(spans(spark, sf), 30 * 86400, 0.5), "r", digits=5)


@query("d3_cascade_events", f"WITH {SPANS}, p AS (SELECT DISTINCT service, time_bucket(INTERVAL '1 day', start_ts) AS b FROM spans WHERE is_error) SELECT b, count(*) AS others FROM p WHERE service <> 'svc-1' AND b IN (SELECT b FROM p WHERE service = 'svc-1') GROUP BY b")
def _(spark, sf):
    return P.cascade_events(spans(spark, sf), "svc-1", 86400)


@query("z1_failure_profile", f"WITH {SPANS} SELECT service, CAST(hour(start_ts) AS INT) AS hour, count(*) AS errors, count(*) > 10 AS frequent FROM spans WHERE is_error GROUP BY ALL")
def _(spark, sf):
    return P.failure_profile(spans(spark, sf))


@query("z2_current_state", f"WITH {SPANS} SELECT service, round(count(*) FILTER (WHERE is_error) * 100.0 / count(*), 4) AS error_rate, round(quantile_cont(duration_ms, 0.95), 4) AS p95 FROM spans GROUP BY service")
def _(spark, sf):
    return rounded(P.current_state(spans(spark, sf), 30 * 86400).select("service", "error_rate", "p95"), "error_rate", "p95")


@query("z3_z5_predictions", f"""WITH {SPANS}, b AS (SELECT service, time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS b, CAST(count(*) FILTER (WHERE is_error) AS DOUBLE) AS e FROM spans GROUP BY ALL),
every AS (SELECT service, lo + k * INTERVAL '30 days' AS b FROM (SELECT service, min(b) AS lo, CAST(round((epoch(max(b)) - epoch(min(b))) / 2592000) AS BIGINT) AS n FROM b GROUP BY service), LATERAL (SELECT unnest(range(0, n + 1)) AS k)), s AS (SELECT service, coalesce(e, 0) AS value, row_number() OVER (PARTITION BY service ORDER BY b) - 1 AS i FROM every LEFT JOIN b USING (service, b)),
l AS (SELECT service, max(i) AS z FROM s GROUP BY service), m AS (SELECT s.service, avg(value) AS m, stddev_pop(value) AS sd FROM s JOIN l USING (service) WHERE i <= z - 2 GROUP BY 1), sig AS (SELECT s.service, least(1.0, greatest(0.0, coalesce((value - m) / nullif(sd, 0), 0)) / 3) AS signal FROM s JOIN l USING (service) JOIN m USING (service) WHERE i = z),
t AS (SELECT service, regr_slope(e, i) / nullif(avg(e), 0) AS slope FROM (SELECT service, e, CAST(row_number() OVER (PARTITION BY service ORDER BY b) AS DOUBLE) AS i FROM b) GROUP BY service), g AS (SELECT service, count(*) FILTER (WHERE is_error) * 100.0 / count(*) AS er, quantile_cont(duration_ms, 0.95) AS p95 FROM spans GROUP BY service),
p AS (SELECT service, least(1.0, least(er / 20, 0.4) + coalesce(signal, 0) * 0.3 + CASE WHEN coalesce(slope, 0) > 0.3 THEN 0.2 ELSE 0 END + CASE WHEN er > 10 OR p95 > 5000 THEN 0.1 ELSE 0 END) AS probability FROM g LEFT JOIN t USING (service) LEFT JOIN sig USING (service))
SELECT service, round(probability, 4) AS probability, CASE WHEN probability > 0.7 THEN '1h' WHEN probability > 0.4 THEN '6h' ELSE '24h' END AS within, CASE WHEN probability > 0.7 THEN 'high' WHEN probability > 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM p""")
def _(spark, sf):
    df = spans(spark, sf)
    s = R.to_series(df, "start_ts", F.count_if("is_error"), 30 * 86400, ["service"])
    signals = X.last_value_signal(s, ["service"]).select("service", "signal")
    return rounded(P.predictions(P.current_state(df, 30 * 86400), signals), "probability")


@query("i1_behaviour_profile", f"WITH {SPANS} SELECT service, count(*) AS requests, count(DISTINCT operation) AS operations, round(count(*) FILTER (WHERE is_error) * 100.0 / count(*), 4) AS error_rate, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95, round(quantile_cont(duration_ms, 0.99), 4) AS p99 FROM spans GROUP BY service")
def _(spark, sf):
    return rounded(P.behaviour_profile(spans(spark, sf)), "error_rate", "p50", "p95", "p99")


@query("i2_i7_deviations", f"WITH {SPANS}, p AS (SELECT service, line AS k, avg(duration_ms) AS a FROM spans GROUP BY ALL), b AS (SELECT service, avg(a) AS m, stddev_pop(a) AS s FROM p WHERE k > 1 GROUP BY service) SELECT p.service, 'a' AS measure, round(abs((p.a - m) / s), 4) AS z FROM p JOIN b USING (service) WHERE k = 1")
def _(spark, sf):
    per = spans(spark, sf).groupBy("service", F.col("line").alias("k")).agg(F.avg("duration_ms").alias("a"))
    return rounded(P.deviations(per.filter("k = 1").select("service", "a"), per.filter("k > 1"), ["a"]).drop("deviation"), "z")


@query("i3_traffic_class", f"WITH {SPANS}, b AS (SELECT service, time_bucket(INTERVAL '7 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS b, count(*) AS n FROM spans GROUP BY ALL) SELECT service, round(stddev_pop(n) / avg(n), 5) AS cv, round(quantile_cont(n, 0.75), 4) AS p75 FROM b GROUP BY service")
def _(spark, sf):
    return rounded(rounded(P.traffic_class(spans(spark, sf), 7 * 86400).select("service", "cv", "p75"), "cv", digits=5), "p75")


@query("i4_error_profile", f"WITH {SPANS} SELECT service, error_type, count(*) AS n, count(DISTINCT operation) AS operations FROM spans WHERE is_error GROUP BY ALL")
def _(spark, sf):
    return spans(spark, sf).filter("is_error").groupBy("service", "error_type").agg(F.count("*").alias("n"), F.count_distinct("operation").alias("operations"))


@query("i5_dependency_pattern", f"WITH {_CALLS}, e AS (SELECT source, target, count(*) AS c, count(*) FILTER (WHERE is_error) AS e FROM calls GROUP BY ALL), u AS (SELECT source AS service, 1 AS o, 0 AS i, c, e FROM e UNION ALL SELECT target, 0, 1, 0, 0 FROM e), g AS (SELECT service, CAST(sum(o) AS BIGINT) AS out, CAST(sum(i) AS BIGINT) AS \"in\", sum(c) AS c, sum(e) AS e FROM u GROUP BY service) SELECT service, out, \"in\", round(1 - e / CAST(c AS DOUBLE), 6) AS reliability FROM g")
def _(spark, sf):
    return rounded(P.dependency_pattern(G.dependency_edges(spans(spark, sf))).select("service", "out", "in", "reliability"), "reliability", digits=6)


@query("i6_resource_stats", f"WITH {METRICS} SELECT service, metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, max(value) AS max, CASE WHEN avg(value) > 80 THEN 'high' WHEN avg(value) > 40 THEN 'normal' ELSE 'low' END AS utilisation FROM metrics GROUP BY ALL")
def _(spark, sf):
    m = F.col("mean")
    g = metrics(spark, sf).groupBy("service", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max"))
    return rounded(g.withColumn("utilisation", F.when(m > 80, "high").when(m > 40, "normal").otherwise("low")), "mean", "std")


@query("f1_f4_incident_timeline", f"WITH {LOGS} SELECT time_bucket(INTERVAL '1 minute', ts) AS minute, count(*) AS logs, count(*) FILTER (WHERE level = 'error') AS error_logs FROM logs WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-10 04:00:00' GROUP BY 1")
def _(spark, sf):
    return P.incident_report(spans(spark, sf), logs(spark, sf), "2024-01-10 02:00:00", 120).select("minute", "logs", "error_logs")


@query("f2_f3_hypotheses", f"WITH {SPANS}, {METRICS}, s AS (SELECT count(*) FILTER (WHERE is_error) / CAST(count(*) AS DOUBLE) AS e, count(DISTINCT CASE WHEN is_error THEN service END) AS n, count(*) FILTER (WHERE error_type = 'Timeout') / CAST(count(*) FILTER (WHERE is_error) AS DOUBLE) AS t FROM spans), m AS (SELECT max(value) > avg(value) + 2 * stddev_pop(value) AS p FROM metrics) SELECT 'error spike' AS hypothesis, e > 0.1 AS supported FROM s UNION ALL SELECT 'cascading failure', n > 3 FROM s UNION ALL SELECT 'timeouts', t > 0.5 FROM s UNION ALL SELECT 'resource peak', p FROM m")
def _(spark, sf):
    return P.hypotheses(spans(spark, sf), metrics(spark, sf))


@query("f5_incident_severity", f"WITH {SPANS}, m AS (SELECT count(*) FILTER (WHERE is_error) / CAST(count(*) AS DOUBLE) AS e, count(DISTINCT CASE WHEN is_error THEN service END) AS s FROM spans), x AS (SELECT e, s, CASE WHEN e > 0.5 THEN 4 WHEN e > 0.2 THEN 3 WHEN e > 0.05 THEN 2 ELSE 0 END + CASE WHEN s > 5 THEN 3 WHEN s > 2 THEN 2 ELSE 1 END AS score FROM m) SELECT round(e, 6) AS error_share, s AS services, score, CASE WHEN score >= 7 THEN 'critical' WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS level FROM x")
def _(spark, sf):
    return rounded(P.incident_severity(spans(spark, sf)), "error_share", digits=6)


@query("m1_system_health", f"""WITH {_CALLS}, {LOGS}, s AS (SELECT count(DISTINCT CASE WHEN is_error THEN trace_id END) * 100.0 / count(DISTINCT trace_id) AS e FROM spans), l AS (SELECT count(*) FILTER (WHERE level = 'error') * 100.0 / count(*) AS l FROM logs), ed AS (SELECT source, target, count(*) FILTER (WHERE is_error) * 100.0 / count(*) AS r, count(*) AS c FROM calls GROUP BY ALL), b AS (SELECT count(*) FILTER (WHERE r > 5 OR c > 10000) AS b FROM ed)
SELECT round(e, 4) AS error_percent, round(l, 4) AS log_error_percent, b AS bottlenecks, round(100 - least(2 * e, 40.0) - least(l, 20.0) - least(5 * b, 20), 4) AS score FROM s, l, b""")
def _(spark, sf):
    df = spans(spark, sf)
    h = P.system_health(df, logs(spark, sf), G.dependency_edges(df))
    return rounded(h.select("error_percent", "log_error_percent", "bottlenecks", "score"), "error_percent", "log_error_percent", "score")
