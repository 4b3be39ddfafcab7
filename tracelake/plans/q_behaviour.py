"""Queries of canaries, service behaviour and dependencies at any depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import behaviour as B
from tracelake.operators import canary as Y
from tracelake.operators import graph as G
from tracelake.operators import regression as E
from tracelake.operators import reports as P
from tracelake.plans.fixtures import LOGS, METRICS, SPANS, logs, metrics, spans
from tracelake.plans.q_regression import _RISKS
from tracelake.plans.q_reports import _STEP
from tracelake.plans.registry import query

WEEK, MONTH = 7 * 86400, 30 * 86400


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _side(name: str) -> str:
    return f"SELECT count(*) AS n, avg(duration_ms) AS m, var_samp(duration_ms) AS v, quantile_cont(duration_ms, 0.99) AS p99, count(*) FILTER (WHERE is_error) AS e FROM spans WHERE service = '{name}'"


_CANARY = f"""{SPANS}, a AS ({_side("gateway")}), b AS ({_side("svc-1")}), n AS (SELECT list_sort(list(error_type)) AS ne FROM (SELECT DISTINCT error_type FROM spans WHERE service = 'gateway' AND error_type IS NOT NULL EXCEPT SELECT error_type FROM spans WHERE service = 'svc-1')),
w AS (SELECT service, time_bucket(INTERVAL '7 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS k, CAST(count(*) AS DOUBLE) AS n FROM spans WHERE service IN ('gateway', 'svc-1') GROUP BY ALL), c AS (SELECT avg(n) AS m, var_samp(n) AS v, count(*) AS k FROM w WHERE service = 'gateway'), d AS (SELECT avg(n) AS m, var_samp(n) AS v, count(*) AS k FROM w WHERE service = 'svc-1'),
x AS (SELECT a.n AS canary_n, b.n AS baseline_n, a.p99 AS canary_p99, b.p99 AS baseline_p99, (a.m - b.m) * 100 / b.m AS lc, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, a.e * 100.0 / a.n - b.e * 100.0 / b.n AS ec, (a.e * 1.0 / a.n - b.e * 1.0 / b.n) / sqrt(((a.e + b.e) * 1.0 / (a.n + b.n)) * (1 - (a.e + b.e) * 1.0 / (a.n + b.n)) * (1.0 / a.n + 1.0 / b.n)) AS z, coalesce(ne, []) AS ne, (c.m - d.m) * 100 / d.m AS tc, (c.m - d.m) / sqrt(c.v / c.k + d.v / d.k) AS tt FROM a, b, n, c, d),
y AS (SELECT *, {_STEP.format('t')} AS lp, {_STEP.format('z')} AS ep, {_STEP.format('tt')} AS tp FROM x),
parts AS (SELECT 'latency' AS part, lc AS change, CASE WHEN lp <= 0.05 AND lc > 0 THEN least(30.0, lc * 0.5) ELSE 0 END AS points FROM y UNION ALL SELECT 'errors', ec, CASE WHEN ep <= 0.05 AND ec > 0 THEN least(40.0, ec * 10) ELSE 0 END FROM y UNION ALL SELECT 'new_errors', len(ne), least(20.0, len(ne) * 10.0) FROM y UNION ALL SELECT 'throughput', tc, CASE WHEN tp <= 0.05 AND tc < -10 THEN least(10.0, abs(tc) * 0.2) ELSE 0 END FROM y)"""


def measures(spark, sf):
    return Y.canary_measures(spans(spark, sf), "gateway", "svc-1", WEEK)


@query("c2_canary_measures", f"WITH {_CANARY} SELECT canary_n, baseline_n, round(canary_p99, 4) AS canary_p99, round(baseline_p99, 4) AS baseline_p99, round(lc, 4) AS latency_change, CAST(lp AS DOUBLE) AS latency_p, round(ec, 4) AS error_change, CAST(ep AS DOUBLE) AS error_p, CAST(len(ne) AS INT) AS new_errors, round(tc, 4) AS throughput_change, CAST(tp AS DOUBLE) AS throughput_p FROM y")
def _(spark, sf):
    m = measures(spark, sf).withColumn("new_errors", F.size("new_errors")).drop("effect")
    return rounded(m, "canary_p99", "baseline_p99", "latency_change", "error_change", "throughput_change")


@query("c2_custom_metrics", f"WITH {METRICS}, g AS (SELECT metric, avg(value) FILTER (WHERE service = 'svc-0') AS c, avg(value) FILTER (WHERE service = 'svc-1') AS b FROM metrics WHERE metric IN ('view', 'click', 'purchase') GROUP BY metric) SELECT metric, round(c, 4) AS canary, round(b, 4) AS baseline, round((c - b) * 100 / b, 4) AS change FROM g")
def _(spark, sf):
    return rounded(Y.custom_metrics(metrics(spark, sf), "svc-0", "svc-1", ["view", "click", "purchase"]), "canary", "baseline", "change")


@query("c4_score_parts", f"WITH {_CANARY} SELECT part, round(change, 4) AS change, round(points, 4) AS points FROM parts")
def _(spark, sf):
    return rounded(Y.score_parts(measures(spark, sf)), "change", "points")


@query("c4_verdict", f"WITH {_CANARY}, s AS (SELECT greatest(0.0, least(100.0, 100 - sum(points))) AS score FROM parts) SELECT round(score, 4) AS score, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 85 THEN 'B+' WHEN score >= 80 THEN 'B' WHEN score >= 75 THEN 'C+' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade, CASE WHEN score >= 85 THEN 'PROMOTE' WHEN score >= 70 THEN 'INVESTIGATE' ELSE 'ROLLBACK' END AS decision, CASE WHEN score >= 95 THEN 'high' WHEN score >= 85 THEN 'medium' WHEN score >= 70 THEN 'low' ELSE 'high' END AS confidence FROM s")
def _(spark, sf):
    return rounded(Y.verdict(Y.score_parts(measures(spark, sf))), "score")


@query("c4_risk_factors", f"WITH {_CANARY} SELECT 'latency_tail' AS risk, 'high' AS severity FROM y WHERE canary_p99 > baseline_p99 * 1.5 UNION ALL SELECT 'error_cascade', 'high' FROM y WHERE len(list_filter(ne, lambda e: regexp_matches(lower(e), 'timeout|circuit'))) > 0 UNION ALL SELECT 'capacity_degradation', 'medium' FROM y WHERE tc < -20")
def _(spark, sf):
    return Y.risk_factors(measures(spark, sf))


@query("i1_log_levels", f"WITH {LOGS}, p AS (SELECT service, level, count(*) AS n FROM logs GROUP BY ALL) SELECT service, level, n, round(n * 100.0 / sum(n) OVER (PARTITION BY service), 4) AS share FROM p")
def _(spark, sf):
    return rounded(B.log_levels(logs(spark, sf)), "share")


def _breakdown(column: str, n: int) -> str:
    return f"WITH {SPANS}, p AS (SELECT service, {column} AS value, count(*) AS requests, count(*) FILTER (WHERE is_error) AS errors FROM spans GROUP BY ALL), r AS (SELECT *, requests * 100.0 / sum(requests) OVER (PARTITION BY service) AS share, row_number() OVER (PARTITION BY service ORDER BY requests DESC, value) AS rank FROM p) SELECT service, value, requests, errors, round(share, 4) AS share, CAST(rank AS INT) AS rank FROM r WHERE rank <= {n}"


@query("i3_operations", _breakdown("operation", 10))
def _(spark, sf):
    return rounded(B.traffic_breakdown(spans(spark, sf), F.col("operation")), "share")


@query("i3_clients", _breakdown("user_id", 5))
def _(spark, sf):
    return rounded(B.traffic_breakdown(spans(spark, sf), F.col("user_id"), 5), "share")


@query("i3_significant_operations", f"WITH {SPANS}, p AS (SELECT service, operation AS value, count(*) AS n FROM spans GROUP BY ALL), f AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY service) AS DOUBLE) AS fg, sum(n) OVER (PARTITION BY value) / CAST(sum(n) OVER () AS DOUBLE) AS bg FROM p), s AS (SELECT service, value, n, (fg - bg) * fg / bg AS score FROM f WHERE fg > bg AND n >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY score DESC, value) AS rank FROM s) SELECT service, value, n, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def _(spark, sf):
    return rounded(B.significant_values(spans(spark, sf), F.col("operation"), 3), "score", digits=6)


@query("i3_peak_hours", f"WITH {LOGS}, p AS (SELECT service, CAST(hour(ts) AS INT) AS hour, count(*) AS requests FROM logs GROUP BY ALL), q AS (SELECT service, quantile_cont(requests, 0.75) AS line FROM p GROUP BY service) SELECT service, hour, requests FROM p JOIN q USING (service) WHERE requests > line")
def _(spark, sf):
    return B.peak_hours(logs(spark, sf).withColumnRenamed("ts", "start_ts"))


_TIMELINE = f"{SPANS}, tl AS (SELECT service, time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS bucket, count(*) FILTER (WHERE is_error) AS errors, count(*) FILTER (WHERE is_error) * 100.0 / count(*) AS error_rate FROM spans GROUP BY ALL)"


@query("i4_error_timeline", f"WITH {_TIMELINE} SELECT service, bucket, errors, round(error_rate, 4) AS error_rate FROM tl")
def _(spark, sf):
    return rounded(B.error_timeline(spans(spark, sf), MONTH), "error_rate")


@query("i4_error_trends", f"WITH {_TIMELINE}, i AS (SELECT *, CAST(row_number() OVER (PARTITION BY service ORDER BY bucket) AS DOUBLE) AS i FROM tl), s AS (SELECT service, coalesce(regr_slope(error_rate, i) / nullif(avg(error_rate), 0), 0) AS slope FROM i GROUP BY service) SELECT service, round(slope, 6) AS slope, CASE WHEN slope > 0.001 THEN 'increasing' WHEN slope < -0.001 THEN 'decreasing' ELSE 'stable' END AS trend FROM s")
def _(spark, sf):
    return rounded(B.error_trends(B.error_timeline(spans(spark, sf), MONTH), 0.001), "slope", digits=6)


@query("i4_error_attributes", f"WITH {SPANS}, l AS (SELECT service, is_error, unnest(['operation', 'line']) AS attribute, unnest([operation, CAST(line AS VARCHAR)]) AS value FROM spans), p AS (SELECT service, attribute, value, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors FROM l GROUP BY ALL), b AS (SELECT service, count(*) FILTER (WHERE is_error) / CAST(count(*) AS DOUBLE) AS base FROM spans GROUP BY service), r AS (SELECT *, errors / CAST(n AS DOUBLE) AS rate FROM p JOIN b USING (service)) SELECT service, attribute, value, errors, round(rate, 5) AS rate, round(rate / base, 5) AS lift FROM r WHERE errors >= 5 AND rate / base > 1")
def _(spark, sf):
    return rounded(B.error_attributes(spans(spark, sf), {"operation": F.col("operation"), "line": F.col("line")}), "rate", "lift", digits=5)


@query("i6_efficiency", f"WITH {METRICS}, g AS (SELECT service, avg(value / 100) FILTER (WHERE metric = 'view') AS c, avg(value / 100) FILTER (WHERE metric = 'click') AS m, max(value / 100) FILTER (WHERE metric = 'view') AS cx, max(value / 100) FILTER (WHERE metric = 'click') AS mx FROM metrics GROUP BY service) SELECT service, round(c, 5) AS cpu_mean, round(m, 5) AS memory_mean, round(cx, 5) AS cpu_max, round(mx, 5) AS memory_max, CASE WHEN (c + m) / 2 > 0.8 THEN 'high' WHEN (c + m) / 2 > 0.4 THEN 'normal' ELSE 'low' END AS use, round(greatest(0.0, (1 - (c + m) / 2) * (1 - abs(c - m))), 5) AS efficiency FROM g")
def _(spark, sf):
    out = B.resource_efficiency(metrics(spark, sf), "view", "click", 100.0)
    return rounded(out.select("service", "cpu_mean", "memory_mean", "cpu_max", "memory_max", "use", "efficiency"), "cpu_mean", "memory_mean", "cpu_max", "memory_max", "efficiency", digits=5)


_PERIODS = f"""{SPANS}, k AS (SELECT unnest(range(0, 8)) AS k), per AS (SELECT s.*, k FROM spans s, k WHERE start_ts >= TIMESTAMP '2001-07-01 00:00:00' - k * INTERVAL '30 days' AND start_ts < TIMESTAMP '2001-07-31 00:00:00' - k * INTERVAL '30 days'),
g AS (SELECT service, k, count(*) AS n, quantile_cont(duration_ms, 0.99) AS p99 FROM per GROUP BY ALL), b AS (SELECT service, avg(n) AS mn, stddev_pop(n) AS sn, avg(p99) AS mp, stddev_pop(p99) AS sp FROM g WHERE k > 0 GROUP BY service), j AS (SELECT service, (n - mn) * 100 / mn AS change, (n - mn) / nullif(sn, 0) AS zn, (p99 - mp) / nullif(sp, 0) AS zp FROM g JOIN b USING (service) WHERE k = 0),
found AS (SELECT service, 'volume_change' AS anomaly, NULL AS subject, change AS value FROM j WHERE abs(change) > 50 UNION ALL SELECT service, 'volume', NULL, zn FROM j WHERE abs(zn) > 3 UNION ALL SELECT service, 'latency', NULL, zp FROM j WHERE zp > 3
UNION ALL SELECT service, 'new_error_type', error_type, count(*) FROM per p WHERE k = 0 AND error_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM per q WHERE q.k > 0 AND q.service = p.service AND q.error_type = p.error_type) GROUP BY service, error_type
UNION ALL SELECT service, 'new_operation', operation, count(*) FROM per p WHERE k = 0 AND NOT EXISTS (SELECT 1 FROM per q WHERE q.k > 0 AND q.service = p.service AND q.operation = p.operation) GROUP BY service, operation HAVING count(*) > 10)"""


def periods(spark, sf):
    """Spans of the current month (k = 0) and of seven before it."""
    k = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    rows = spans(spark, sf).select("*", k)
    lo, hi = (F.lit(t).cast("timestamp_ntz") - F.make_dt_interval(F.col("k") * 30) for t in ("2001-07-01 00:00:00", "2001-07-31 00:00:00"))
    rows = rows.filter((F.col("start_ts") >= lo) & (F.col("start_ts") < hi))
    return rows.filter("k = 0"), rows.filter("k > 0")


@query("i7_anomalies", f"WITH {_PERIODS} SELECT service, anomaly, subject, round(value, 4) AS value FROM found")
def _(spark, sf):
    return rounded(B.behaviour_anomalies(*periods(spark, sf)), "value")


@query("i7_behaviour_score", f"WITH {_PERIODS}, c AS (SELECT service, count(*) AS n, sum(CASE WHEN anomaly IN ('latency', 'volume', 'volume_change') THEN 15 ELSE 10 END) AS cost FROM found GROUP BY service), s AS (SELECT service, coalesce(n, 0) AS anomalies, CAST(greatest(0, 100 - coalesce(cost, 0)) AS BIGINT) AS score FROM (SELECT DISTINCT service FROM per WHERE k = 0) LEFT JOIN c USING (service)) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s")
def _(spark, sf):
    now, before = periods(spark, sf)
    return B.behaviour_score(B.behaviour_anomalies(now, before), now)


#: The dependencies as a chain: a service and the next one.
_NEXT = "target = CASE source WHEN 'gateway' THEN 'svc-0' ELSE concat('svc-', CAST(substr(source, 5) AS INT) + 1) END"
_CHAIN = _RISKS.replace("WITH ", "", 1).split(", cl AS")[0] + f""", eg AS (SELECT source, target, count(*) AS calls FROM calls WHERE {_NEXT} GROUP BY ALL), walk AS (SELECT target AS service, 1 AS depth FROM eg WHERE source = 'gateway' UNION SELECT eg.target, depth + 1 FROM walk JOIN eg ON eg.source = walk.service WHERE depth < 5),
dp AS (SELECT service, min(depth) AS depth FROM walk WHERE service <> 'gateway' GROUP BY service), cl AS (SELECT target AS service, CAST(sum(calls) AS BIGINT) AS calls FROM eg GROUP BY target),
rk AS (SELECT *, CASE WHEN error_rate > 10 THEN 30 WHEN error_rate > 5 THEN 15 ELSE 0 END + CASE WHEN p95 > 2000 THEN 20 WHEN p95 > 1000 THEN 10 ELSE 0 END + CASE WHEN availability < 95 THEN 30 WHEN availability < 99 THEN 15 ELSE 0 END + CASE WHEN depth = 1 AND calls > 1000 THEN 10 ELSE 0 END + CASE WHEN depth > 2 THEN 15 ELSE 0 END AS risk_score FROM dp JOIN hl USING (service) JOIN cl USING (service)), lv AS (SELECT *, CASE WHEN risk_score > 50 THEN 'high' WHEN risk_score > 25 THEN 'medium' ELSE 'low' END AS risk FROM rk)"""


@query("d1_d2_transitive_risks", f"WITH RECURSIVE {_CHAIN} SELECT service, depth, calls, round(p95, 4) AS p95, risk_score, risk, CASE WHEN risk = 'high' AND calls > 1000 THEN 'critical' WHEN depth = 1 AND calls > 5000 AND score < 70 THEN 'critical' WHEN score < 70 AND calls > 500 THEN 'high' WHEN depth > 2 AND score < 80 THEN 'medium' ELSE 'low' END AS criticality, depth > 2 AS deep FROM lv")
def _(spark, sf):
    df = spans(spark, sf)
    edges = G.dependency_edges(df).filter(F.expr(_NEXT))
    out = E.dependency_risks(edges, P.dependency_health(df, 86400), "gateway")
    return rounded(out.select("service", F.col("depth").cast("int").alias("depth"), "calls", "p95", "risk_score", "risk", "criticality", F.contains("factors", F.lit("Deep transitive")).alias("deep")), "p95")


@query("d2_top_risks", f"WITH RECURSIVE {_CHAIN} SELECT service, risk_score, risk FROM lv ORDER BY risk_score DESC, service LIMIT 5")
def _(spark, sf):
    df = spans(spark, sf)
    edges = G.dependency_edges(df).filter(F.expr(_NEXT))
    return E.dependency_risks(edges, P.dependency_health(df, 86400), "gateway").orderBy(F.desc("risk_score"), "service").limit(5).select("service", "risk_score", "risk")
