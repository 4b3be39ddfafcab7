"""Queries of regressions, dependency risks, throughput tests and hop gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import graph as G
from tracelake.operators import regression as E
from tracelake.operators import reports as P
from tracelake.operators import trees as T
from tracelake.plans.fixtures import METRICS, SPANS, metrics, spans
from tracelake.plans.q_graph import _CALLS
from tracelake.plans.q_spans import _PATHS
from tracelake.plans.registry import query


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


_FOUND = f"""{SPANS}, k AS (SELECT unnest(range(0, 8)) AS k), w AS (SELECT service, unnest([operation, NULL]) AS operation, k, duration_ms, is_error FROM spans, k WHERE start_ts >= TIMESTAMP '1996-06-01 00:00:00' - k * INTERVAL '30 days' AND start_ts < TIMESTAMP '1996-07-01 00:00:00' - k * INTERVAL '30 days'),
pm AS (SELECT service, operation, k, count(*) AS requests, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99, 100 - count(*) FILTER (WHERE is_error) * 100.0 / count(*) AS success FROM w GROUP BY ALL),
lg AS (SELECT service, operation, k, unnest(['p50', 'p95', 'p99', 'success']) AS metric, unnest([p50, p95, p99, success]) AS value FROM pm), bs AS (SELECT service, operation, metric, avg(value) AS baseline, stddev_pop(value) AS std FROM lg WHERE k > 0 GROUP BY ALL),
jn AS (SELECT l.service, l.operation, l.metric, value AS current, baseline, CASE WHEN l.metric = 'success' THEN -1 ELSE 1 END * (value - baseline) / nullif(std, 0) AS z FROM lg l JOIN bs b ON b.service = l.service AND b.operation IS NOT DISTINCT FROM l.operation AND b.metric = l.metric WHERE k = 0),
found AS (SELECT *, (current - baseline) * 100 / baseline AS change, CASE WHEN metric = 'success' THEN CASE WHEN current < 95 OR baseline - current > 5 THEN 'critical' WHEN current < 98 OR baseline - current > 2 THEN 'high' WHEN current < 99 OR baseline - current > 1 THEN 'medium' ELSE 'low' END
  ELSE CASE WHEN z * f > 5 THEN 'critical' WHEN z * f > 3.5 THEN 'high' WHEN z * f > 2.5 THEN 'medium' ELSE 'low' END END AS severity FROM (SELECT *, CASE metric WHEN 'p99' THEN 1.5 WHEN 'p95' THEN 1.2 ELSE 1.0 END AS f FROM jn) WHERE z > 1.2 AND (metric <> 'success' OR current < 99))"""


def measures(spark, sf):
    return E.period_measures(spans(spark, sf), "1996-06-01 00:00:00", "1996-07-01 00:00:00", 7, 30)


def found(spark, sf):
    return E.regressions(measures(spark, sf), 1.2)


@query("k1_period_measures", f"WITH {_FOUND} SELECT service, operation, k, requests, round(p50, 2) AS p50, round(p95, 2) AS p95, round(p99, 2) AS p99, round(success, 4) AS success FROM pm")
def _(spark, sf):
    return rounded(rounded(measures(spark, sf), "success"), "p50", "p95", "p99", digits=2)


@query("k1_k2_all_regressions", f"WITH {_FOUND} SELECT service, operation, metric, round(current, 4) AS current, round(baseline, 4) AS baseline, round(z, 4) AS z, round(change, 4) AS change, severity FROM found")
def _(spark, sf):
    return rounded(found(spark, sf), "current", "baseline", "z", "change")


@query("k3_latency_course", f"""WITH {SPANS}, b AS (SELECT service, time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS b, quantile_cont(duration_ms, 0.95) AS p95 FROM spans GROUP BY ALL), s AS (SELECT service, p95, p95 / lag(p95) OVER w AS step, CAST(row_number() OVER w AS DOUBLE) AS i FROM b WINDOW w AS (PARTITION BY service ORDER BY b))
SELECT service, round(max(step), 4) AS step, max(step) > 2 AS sudden, round(regr_slope(p95, i), 5) AS slope, round(regr_r2(p95, i), 5) AS r2, coalesce(regr_slope(p95, i) > 0 AND regr_r2(p95, i) > 0.5, false) AS gradual FROM s GROUP BY service""")
def _(spark, sf):
    return rounded(rounded(E.latency_course(spans(spark, sf), 30 * 86400), "step"), "slope", "r2", digits=5)


@query("k3_patterns", f"WITH {_FOUND}, o AS (SELECT service, operation, count(*) AS n FROM found GROUP BY ALL) SELECT service, count(operation) AS operations, count(*) FILTER (WHERE operation IS NOT NULL AND n >= 2) AS concentrated, count(operation) > 3 AS widespread, round(coalesce(sum(n) FILTER (WHERE operation IS NOT NULL), 0) * 100.0 / sum(n), 4) AS in_operations FROM o GROUP BY service")
def _(spark, sf):
    return rounded(E.patterns(found(spark, sf)), "in_operations")


@query("k4_causes", f"""WITH {_FOUND}, {METRICS}, b AS (SELECT service, time_bucket(INTERVAL '7 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS b, count(*) AS n FROM spans GROUP BY ALL)
SELECT service, 'traffic_spike' AS cause, 'high' AS confidence FROM b GROUP BY service HAVING max(n) > 2 * avg(n) UNION ALL SELECT service, 'resource_constraint', 'high' FROM metrics WHERE metric = 'view' GROUP BY service HAVING max(value) > 480 UNION ALL SELECT DISTINCT service, 'dependency_degradation', 'medium' FROM found WHERE contains(operation, 'external') UNION ALL SELECT DISTINCT service, 'data_growth', 'low' FROM found WHERE metric <> 'success' AND change > 100""")
def _(spark, sf):
    return E.causes(spans(spark, sf), metrics(spark, sf), found(spark, sf), 7 * 86400, "view", 480.0)


@query("k5_impact", f"""WITH {_FOUND}, g AS (SELECT service, count(*) AS regressions, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE metric <> 'success') AS l, count(*) FILTER (WHERE metric = 'success') AS s, count(*) FILTER (WHERE metric IN ('p95', 'p99') AND severity = 'critical') AS hc, count(*) FILTER (WHERE metric IN ('p95', 'p99') AND severity = 'high') AS hh, count(*) FILTER (WHERE metric <> 'success' AND change > 200) AS far FROM found GROUP BY service), x AS (SELECT *, CASE WHEN hc > 0 THEN 100 WHEN hh > 0 THEN 75 WHEN l > 3 THEN 50 ELSE 0 END AS impact FROM g)
SELECT service, regressions, critical, high, CASE WHEN critical > 0 THEN 'critical' WHEN high > 2 THEN 'high' WHEN high > 0 OR regressions > 5 THEN 'medium' ELSE 'low' END AS severity, impact, s > 0 OR impact > 75 AS sla_risk, CASE WHEN regressions > 5 THEN 'high' WHEN regressions > 2 THEN 'medium' ELSE 'low' END AS cascading_risk, far > 0 AS scalability, CASE WHEN impact > 75 OR critical > 0 THEN 'immediate' WHEN impact > 50 OR high > 0 THEN 'urgent' WHEN impact > 25 THEN 'planned' ELSE 'low' END AS urgency FROM x""")
def _(spark, sf):
    return E.impact(found(spark, sf))


_RISKS = f"""WITH {_CALLS}, dh AS (SELECT service, count(*) FILTER (WHERE is_error) * 100.0 / count(*) AS error_rate, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99 FROM spans GROUP BY service), bk AS (SELECT service, time_bucket(INTERVAL '1 day', start_ts) AS b, count(*) FILTER (WHERE NOT is_error) / CAST(count(*) AS DOUBLE) AS ok FROM spans GROUP BY ALL), av AS (SELECT service, count(*) FILTER (WHERE ok >= 0.95) * 100.0 / count(*) AS availability FROM bk GROUP BY service),
hl AS (SELECT *, greatest(0.0, 100 - least(2 * error_rate, 40.0) - CASE WHEN p95 > 1000 THEN 30 WHEN p95 > 500 THEN 15 ELSE 0 END - (100 - availability) * 0.3) AS score FROM dh JOIN av USING (service)), cl AS (SELECT target AS service, count(*) AS calls FROM calls GROUP BY target),
rk AS (SELECT *, CASE WHEN error_rate > 10 THEN 30 WHEN error_rate > 5 THEN 15 ELSE 0 END + CASE WHEN p95 > 2000 THEN 20 WHEN p95 > 1000 THEN 10 ELSE 0 END + CASE WHEN availability < 95 THEN 30 WHEN availability < 99 THEN 15 ELSE 0 END + CASE WHEN calls > 1000 THEN 10 ELSE 0 END AS risk_score FROM hl JOIN cl USING (service)),
lv AS (SELECT *, CASE WHEN risk_score > 50 THEN 'high' WHEN risk_score > 25 THEN 'medium' ELSE 'low' END AS risk FROM rk)"""


def risks(spark, sf):
    df = spans(spark, sf)
    return E.dependency_risks(G.dependency_edges(df), P.dependency_health(df, 86400))


@query("d1_d2_dependency_risks", _RISKS + " SELECT service, calls, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p99, 4) AS p99, risk_score, risk, concat_ws(', ', CASE WHEN error_rate > 10 THEN 'High error rate' WHEN error_rate > 5 THEN 'Elevated error rate' END, CASE WHEN p95 > 2000 THEN 'High latency' WHEN p95 > 1000 THEN 'Moderate latency' END, CASE WHEN availability < 95 THEN 'Low availability' WHEN availability < 99 THEN 'Suboptimal availability' END, CASE WHEN calls > 1000 THEN 'High-volume direct dependency' END) AS factors, CASE WHEN risk = 'high' AND calls > 1000 THEN 'critical' WHEN calls > 5000 AND score < 70 THEN 'critical' WHEN score < 70 AND calls > 500 THEN 'high' ELSE 'low' END AS criticality FROM lv")
def _(spark, sf):
    return rounded(risks(spark, sf).select("service", "calls", "p50", "p95", "p99", "risk_score", "risk", "factors", "criticality"), "p50", "p95", "p99")


@query("d2_risk_distribution", _RISKS + " SELECT risk, count(*) AS dependencies, round(avg(risk_score), 4) AS mean_score FROM lv GROUP BY risk")
def _(spark, sf):
    return rounded(E.risk_distribution(risks(spark, sf)), "mean_score")


@query("c2_c4_canary_throughput", f"""WITH {SPANS}, b AS (SELECT service, time_bucket(INTERVAL '7 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS b, CAST(count(*) AS DOUBLE) AS n FROM spans WHERE service IN ('svc-0', 'svc-1') GROUP BY ALL), x AS (SELECT avg(n) AS m, var_samp(n) AS v, count(*) AS c FROM b WHERE service = 'svc-0'), y AS (SELECT avg(n) AS m, var_samp(n) AS v, count(*) AS c FROM b WHERE service = 'svc-1'), z AS (SELECT x.m AS canary, y.m AS baseline, (x.m - y.m) * 100 / y.m AS change, (x.m - y.m) / sqrt(x.v / x.c + y.v / y.c) AS t FROM x, y),
w AS (SELECT *, CASE WHEN abs(t) > 3.291 THEN 0.001 WHEN abs(t) > 2.576 THEN 0.01 WHEN abs(t) > 1.96 THEN 0.05 WHEN abs(t) > 1.645 THEN 0.1 ELSE 0.2 END AS p FROM z)
SELECT round(canary, 4) AS canary, round(baseline, 4) AS baseline, round(change, 4) AS change, round(t, 5) AS t, CAST(p AS DOUBLE) AS p, round(CASE WHEN p <= 0.05 AND change < -10 THEN least(10.0, abs(change) * 0.2) ELSE 0 END, 4) AS penalty FROM w""")
def _(spark, sf):
    t = E.throughput_test(spans(spark, sf), "svc-0", "svc-1", 7 * 86400).drop("risk")
    return rounded(rounded(t, "canary", "baseline", "change", "penalty"), "t", digits=5)


@query("g13_g14_hop_gaps", _PATHS + """, hp AS (SELECT services[i] AS source, services[i + 1] AS target, greatest(0.0, durations[i] - durations[i + 1]) AS gap FROM (SELECT services, durations, unnest(range(1, len(path))) AS i FROM best WHERE k = 1))
SELECT source, target, round(avg(gap), 4) AS avg, round(quantile_cont(gap, 0.95), 4) AS p95, count(*) AS frequency, round((avg(gap) * 0.5 + quantile_cont(gap, 0.95) * 0.3) * ln(count(*) + 1), 4) AS score, round(avg(gap) / 2, 4) AS saving_ms FROM hp GROUP BY source, target""")
def _(spark, sf):
    return rounded(E.path_gaps(T.critical_paths(spans(spark, sf))), "avg", "p95", "score", "saving_ms")
