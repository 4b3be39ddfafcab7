"""Queries of incidents, known patterns, severity, health and retry impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import graph as G
from tracelake.operators import incident as N
from tracelake.operators import reports as P
from tracelake.plans.fixtures import LOGS, METRICS, SPANS, logs, metrics, spans, spans_once
from tracelake.plans.q_graph import _CALLS
from tracelake.plans.registry import query

MONTH = 30 * 86400
#: The event metrics stand for CPU and memory; their limits are in their own units.
RESOURCES = {"cpu": "view", "memory": "click"}
#: The known patterns, and patterns of the given data.
RULES = (
    *N.RULES,
    ("Failing requests", "high", "messages", "message", "failed request", ">", 0.0, 2.0), ("Failing requests", "high", "messages", "message", "no such words", ">", 0.0, 1.0),
    ("Failing requests", "high", "latency", "p99_ms", None, ">", 2000.0, 1.0), ("Failing requests", "high", "errors", "error_rate", None, "<=", 0.3, 1.0), ("Failing requests", "high", "services", "failing_service", "svc-", ">=", 8.0, 1.0),
    ("Quiet logs", "low", "logs", "error_logs", None, "<", 10.0, 1.0),
)


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("f1_error_samples", f"""WITH {SPANS}, p AS (SELECT service, operation, trace_id, count(*) AS c FROM spans WHERE is_error GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY service, operation ORDER BY c DESC, trace_id) AS r FROM p)
SELECT service, operation, CAST(sum(c) AS BIGINT) AS errors, count(*) AS traces, list(trace_id ORDER BY r) FILTER (WHERE r <= 5) AS samples FROM r GROUP BY ALL""")
def _(spark, sf):
    return N.error_samples(spans(spark, sf))


@query("f1_minutes", f"""WITH {SPANS}, {LOGS}, s AS (SELECT time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS bucket, count(*) AS spans, count(*) FILTER (WHERE is_error) AS errors, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99 FROM spans GROUP BY 1),
l AS (SELECT time_bucket(INTERVAL '30 days', ts, TIMESTAMP '1970-01-01 00:00:00') AS bucket, count(*) AS logs, count(*) FILTER (WHERE level = 'error') AS error_logs, count(*) FILTER (WHERE level = 'warn') AS warnings, count(*) FILTER (WHERE level = 'info') AS infos FROM logs GROUP BY 1)
SELECT bucket, coalesce(spans, 0) AS spans, coalesce(errors, 0) AS errors, round(p95, 2) AS p95, round(p99, 2) AS p99, coalesce(logs, 0) AS logs, error_logs, warnings, infos FROM s FULL JOIN l USING (bucket)""")
def _(spark, sf):
    out = N.minutes_of(spans(spark, sf), logs(spark, sf), MONTH)
    return rounded(out.select("bucket", "spans", "errors", "p95", "p99", "logs", *[F.col("levels")[k].alias(n) for k, n in (("error", "error_logs"), ("warn", "warnings"), ("info", "infos"))]), "p95", "p99", digits=2)


@query("f1_error_messages", f"WITH {LOGS} SELECT message, count(*) AS count FROM logs WHERE level IN ('error', 'fatal') GROUP BY message ORDER BY count DESC, message LIMIT 20")
def _(spark, sf):
    return N.top_error_messages(logs(spark, sf))


@query("f1_logs_around", f"WITH {LOGS} SELECT event_id, level, message FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-10 01:30:00' AND TIMESTAMP '2024-01-10 02:30:00'")
def _(spark, sf):
    return N.around(logs(spark, sf), "ts", "2024-01-10 02:00:00", 30, 30).select("event_id", "level", "message")


@query("f1_metric_stats", f"""WITH {METRICS}, b AS (SELECT metric, time_bucket(INTERVAL '1 hour', ts) AS b, avg(value) AS m FROM metrics GROUP BY ALL), p AS (SELECT metric, arg_max(b, (m, b)) AS peak FROM b GROUP BY metric)
SELECT metric, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, max(value) > avg(value) + 2 * stddev_pop(value) AS anomalous, any_value(peak) AS peak FROM metrics JOIN p USING (metric) GROUP BY metric""")
def _(spark, sf):
    return rounded(N.metric_stats(metrics(spark, sf), 3600), "mean", "std")


def _text(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)


_SAID = sorted({r[4] for r in RULES if r[3] == "message"})
_NAMED = sorted({r[4] for r in RULES if r[3] == "failing_service"})
_MATCHES = f"""{SPANS}, {LOGS}, {METRICS}, rules(pattern, confidence, chk, signal, subject, comparison, lim, weight) AS (VALUES {", ".join("(" + ", ".join(map(_text, r)) + ")" for r in RULES)}),
said AS (SELECT unnest([{", ".join(map(_text, _SAID))}]) AS x), named AS (SELECT unnest([{", ".join(map(_text, _NAMED))}]) AS x), ps AS (SELECT service, count(*) AS n, count(*) FILTER (WHERE is_error) AS e FROM spans GROUP BY service),
seen AS (SELECT 'message' AS signal, x AS subject, CAST(count(*) FILTER (WHERE level = 'error' AND contains(lower(message), x)) AS DOUBLE) AS value FROM said, logs GROUP BY x UNION ALL SELECT 'error_logs', NULL, count(*) FROM logs WHERE level = 'error' UNION ALL SELECT 'failing_service', x, count(*) FILTER (WHERE e > 0 AND contains(lower(service), x)) FROM named, ps GROUP BY x
UNION ALL SELECT 'error_rate', NULL, sum(e) / CAST(sum(n) AS DOUBLE) FROM ps UNION ALL SELECT 'failing_services', NULL, count(*) FILTER (WHERE e > 0) FROM ps UNION ALL SELECT 'p99_ms', NULL, max(p) FROM (SELECT quantile_cont(duration_ms, 0.99) AS p FROM spans GROUP BY time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00'))
UNION ALL SELECT 'cpu_max', NULL, max(value) FROM metrics WHERE metric = 'view' UNION ALL SELECT 'memory_max', NULL, max(value) FROM metrics WHERE metric = 'click'),
j AS (SELECT r.*, coalesce(CASE comparison WHEN '>' THEN value > lim WHEN '>=' THEN value >= lim WHEN '<' THEN value < lim ELSE value <= lim END, false) AS ok FROM rules r LEFT JOIN seen s ON s.signal = r.signal AND s.subject IS NOT DISTINCT FROM r.subject),
c AS (SELECT pattern, confidence, chk, sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight) AS share, count(*) FILTER (WHERE ok) AS held FROM j GROUP BY ALL), matches AS (SELECT pattern, confidence, avg(share) AS match, count(*) AS checks, CAST(sum(held) AS INT) AS held FROM c GROUP BY ALL)"""


@query("f3_pattern_matches", f"WITH {_MATCHES} SELECT pattern, confidence, round(match, 4) AS match, checks, held FROM matches")
def _(spark, sf):
    seen = N.observed(spans(spark, sf), logs(spark, sf), metrics(spark, sf), RULES, RESOURCES, MONTH)
    out = N.pattern_matches(seen, N.rule_table(spark, RULES))
    return rounded(out.select("pattern", "confidence", "match", "checks", F.size("evidence").alias("held")), "match")


@query("f3_hypotheses", f"WITH {_MATCHES} SELECT pattern, confidence, round(match, 4) AS match FROM matches WHERE match > 0.7")
def _(spark, sf):
    return rounded(N.hypotheses(spans(spark, sf), logs(spark, sf), metrics(spark, sf), RULES, RESOURCES, MONTH).select("pattern", "confidence", "match"), "match")


_FACTORS = f"""{SPANS}, {METRICS}, x AS (SELECT count(*) FILTER (WHERE is_error) / CAST(count(*) AS DOUBLE) AS e, count(DISTINCT CASE WHEN is_error THEN service END) AS s FROM spans), y AS (SELECT coalesce(max(value) FILTER (WHERE metric = 'view'), 0) / 1000 AS cpu, coalesce(max(value) FILTER (WHERE metric = 'click'), 0) / 1000 AS memory FROM metrics),
f AS (SELECT 'error_rate' AS factor, e AS value, CASE WHEN e > 0.5 THEN 3 WHEN e > 0.2 THEN 2 WHEN e > 0.05 THEN 1 ELSE 0 END AS points FROM x UNION ALL SELECT 'service_spread', CAST(s AS DOUBLE), CASE WHEN s > 5 THEN 3 WHEN s > 2 THEN 2 ELSE 0 END FROM x UNION ALL SELECT 'resource_exhaustion', greatest(cpu, memory), CASE WHEN cpu > 0.9 OR memory > 0.95 THEN 3 WHEN cpu > 0.8 OR memory > 0.9 THEN 2 ELSE 0 END FROM y)"""


def factors(spark, sf):
    return N.severity_factors(spans(spark, sf), metrics(spark, sf).withColumn("value", F.col("value") / 1000), RESOURCES)


@query("f5_severity_factors", f"WITH {_FACTORS} SELECT factor, round(value, 6) AS value, points FROM f")
def _(spark, sf):
    return rounded(factors(spark, sf), "value", digits=6)


@query("f5_severity", f"WITH {_FACTORS} SELECT CAST(sum(points) AS BIGINT) AS score, CASE WHEN sum(points) >= 7 THEN 'critical' WHEN sum(points) >= 5 THEN 'high' WHEN sum(points) >= 3 THEN 'medium' ELSE 'low' END AS level FROM f")
def _(spark, sf):
    return N.severity(factors(spark, sf))


_NECKS = f"""{_CALLS}, op AS (SELECT operation, count(*) AS n, avg(duration_ms) AS a FROM spans GROUP BY operation ORDER BY n DESC, operation LIMIT 20), p AS (SELECT list_sort(list(duration_ms))[greatest(CAST(ceil(0.95 * count(*)) AS BIGINT), 1)] AS p95 FROM spans), eg AS (SELECT source, target, count(*) AS c, count(*) FILTER (WHERE is_error) * 100.0 / count(*) AS er FROM calls GROUP BY ALL),
necks AS (SELECT 'high_latency' AS kind, operation AS name, CAST(a AS DOUBLE) AS value FROM op, p WHERE a > p95 UNION ALL SELECT 'high_error_rate', concat(source, ' -> ', target), er FROM eg WHERE er > 5 UNION ALL SELECT 'high_volume', concat(source, ' -> ', target), c FROM (SELECT * FROM eg ORDER BY c DESC, source, target LIMIT 3) WHERE c > 100)"""


@query("m1_bottlenecks", f"WITH {_NECKS} SELECT kind, name, round(value, 4) AS value FROM necks")
def _(spark, sf):
    df = spans_once(spark, sf, "operation")
    return rounded(N.bottlenecks(df, G.dependency_edges(df), many=100), "value")


@query("m1_health_summary", f"""WITH {_NECKS}, {LOGS}, {METRICS}, s AS (SELECT count(DISTINCT trace_id) AS traces, count(DISTINCT CASE WHEN is_error THEN trace_id END) * 100.0 / count(DISTINCT trace_id) AS e FROM spans), l AS (SELECT count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warn') AS warnings, count(*) AS n FROM logs),
m AS (SELECT avg(value) FILTER (WHERE metric = 'view') AS c, max(value) FILTER (WHERE metric = 'view') AS cm, avg(value) FILTER (WHERE metric = 'click') AS y, max(value) FILTER (WHERE metric = 'click') AS ym FROM metrics), b AS (SELECT count(*) AS b, count(*) FILTER (WHERE kind = 'high_latency') AS so FROM necks), z AS (SELECT *, round(greatest(0.0, 100 - least(e * 2, 40.0) - least(errors * 100.0 / n, 20.0) - least(b * 5, 20))) AS score FROM s, l, m, b)
SELECT traces, round(e, 4) AS error_percent, errors AS error_logs, warnings, round(errors * 100.0 / n, 4) AS log_error_percent, round(c, 4) AS cpu_mean, cm AS cpu_max, round(y, 4) AS memory_mean, ym AS memory_max, b AS bottlenecks, so AS slow_operations, score, CASE WHEN score >= 90 THEN 'healthy' WHEN score >= 70 THEN 'degraded' WHEN score >= 50 THEN 'unhealthy' ELSE 'critical' END AS status FROM z""")
def _(spark, sf):
    df = spans_once(spark, sf, "operation")
    h = N.health_summary(df, logs(spark, sf), metrics(spark, sf), G.dependency_edges(df), RESOURCES, 100)
    h = h.select("traces", "error_percent", F.col("levels")["error"].alias("error_logs"), F.col("levels")["warn"].alias("warnings"), "log_error_percent", "cpu_mean", "cpu_max", "memory_mean", "memory_max", "bottlenecks", "slow_operations", "score", "status")
    return rounded(h, "error_percent", "log_error_percent", "cpu_mean", "memory_mean")


_STORMS = f"""{SPANS}, rr AS (SELECT *, line % 2 = 1 AS retry FROM spans), st AS (SELECT service, operation, count(*) AS requests, count(DISTINCT trace_id) AS traces, count(*) FILTER (WHERE retry) AS retries FROM rr GROUP BY ALL), storms AS (SELECT *, requests / CAST(traces AS DOUBLE) AS ratio, retries / CAST(requests AS DOUBLE) AS share FROM st WHERE retries > 0 AND requests >= 10 AND requests / CAST(traces AS DOUBLE) >= 1.0)"""


@query("q5_retry_impact", f"""WITH {_STORMS}, g AS (SELECT count(*) AS storms, count(DISTINCT service) AS services, CAST(sum(retries) AS BIGINT) AS r, CAST(sum(requests) AS BIGINT) AS n, exp(sum(ln(CASE WHEN ratio * 4 > 5 THEN 1.5 WHEN ratio * 4 > 3 THEN 1.3 WHEN ratio * 4 > 2 THEN 1.1 ELSE 1.0 END))) AS product, bool_or(share > 0.5) AS critical FROM storms)
SELECT storms, services, r * 2 AS wasted, round(r * 200.0 / n, 4) AS wasted_percent, round(r * 2 * 0.0001, 6) AS compute_cost, round(r * 2 * 0.0001 * 1.3, 6) AS total_cost, round((n - r) * 100.0 / n, 4) AS success_rate, 2300.0 AS added_ms, 2600.0 AS added_p95_ms, CASE WHEN r > 10000 THEN 'high' WHEN r > 1000 THEN 'medium' ELSE 'low' END AS user_impact, CASE WHEN critical THEN 'high' WHEN storms > 5 THEN 'medium' ELSE 'low' END AS cascading_risk, round(least(product, 10.0), 6) AS amplification FROM g""")
def _(spark, sf):
    storms = P.retry_storms(spans(spark, sf), F.col("line") % 2 == 1, least=10, least_ratio=1.0).withColumn("ratio", F.col("ratio") * 4)
    out = N.retry_impact(storms)
    out = out.withColumns({c: F.col(c).cast("double") for c in ("added_ms", "added_p95_ms")})
    return rounded(rounded(out, "wasted_percent", "success_rate"), "compute_cost", "total_cost", "amplification", digits=6)
