"""Queries of failure prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions.lineage import cut_lineage
from tracelake.operators import graph as G
from tracelake.operators import prediction as D
from tracelake.plans.fixtures import METRICS, SPANS, metrics, spans, spans_once
from tracelake.plans.registry import query

MONTH = 30 * 86400
#: The moment that predictions are made at, and its hour.
NOW, HOUR = "1999-01-01 00:00:00", 5
#: Resources of the event metrics: limit, hours to a risk, hours to a critical one.
LIMITS = {"view": (500.0, 2000.0, 300.0), "click": (500.0, 2000.0, 300.0), "purchase": (300.0, 2000.0, 300.0)}


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


def past(spark, sf):
    return spans_once(spark, sf, "start_ts", where=f"start_ts < timestamp_ntz'{NOW}'")


def _series(rows: str) -> str:
    return f"""pb AS (SELECT service, time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS b, count(*) AS n, count(*) FILTER (WHERE is_error) AS e, avg(duration_ms) AS l FROM {rows} GROUP BY ALL),
ev AS (SELECT service, lo + k * INTERVAL '30 days' AS b FROM (SELECT service, min(b) AS lo, CAST(round((epoch(max(b)) - epoch(min(b))) / 2592000) AS BIGINT) AS m FROM pb GROUP BY service), LATERAL (SELECT unnest(range(0, m + 1)) AS k)),
s0 AS (SELECT service, b, coalesce(n, 0) AS requests, coalesce(e, 0) AS errors, coalesce(l, 0) AS latency, row_number() OVER (PARTITION BY service ORDER BY b) - 1 AS i FROM ev LEFT JOIN pb USING (service, b)),
ser AS (SELECT *, CASE WHEN requests > 0 THEN errors * 100.0 / requests ELSE 0 END AS error_rate FROM s0)"""


def _line(rows: str) -> str:
    return f"""fb AS (SELECT time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS b, count(*) AS e FROM {rows} WHERE is_error GROUP BY 1),
fe AS (SELECT lo + k * INTERVAL '30 days' AS b FROM (SELECT min(b) AS lo, CAST(round((epoch(max(b)) - epoch(min(b))) / 2592000) AS BIGINT) AS m FROM fb), LATERAL (SELECT unnest(range(0, m + 1)) AS k)),
fline AS (SELECT b, coalesce(e, 0) AS errors, row_number() OVER (ORDER BY b) - 1 AS i FROM fe LEFT JOIN fb USING (b)),
whole AS (SELECT coalesce(regr_slope(CAST(errors AS DOUBLE), CAST(i AS DOUBLE)) / nullif(avg(errors), 0), 0) AS trend, avg(errors) AS m, stddev_pop(errors) AS s, count(*) AS buckets FROM fline)"""


def _patterns(rows: str, per: int) -> str:
    return f"""{_line(rows)}, patterns AS (SELECT 'increasing_failures' AS pattern, CAST(NULL AS VARCHAR) AS service, trend AS strength, CASE WHEN trend > 0.5 THEN 'high' ELSE 'medium' END AS severity FROM whole WHERE trend > 0.2
UNION ALL SELECT 'failure_bursts', NULL, CAST(count(*) AS DOUBLE), 'high' FROM fline, whole WHERE errors > m + 2 * s HAVING count(*) > 0
UNION ALL SELECT 'service_specific', service, CAST(count(*) AS DOUBLE), 'medium' FROM {rows}, whole WHERE is_error GROUP BY service, buckets HAVING count(*) > {per} * buckets)"""


def _peaks(rows: str) -> str:
    return f"""pk AS (SELECT unit, value, count(*) AS count FROM (SELECT unnest(['hour', 'day']) AS unit, unnest([CAST(hour(start_ts) AS INT), CAST(isodow(start_ts) AS INT)]) AS value FROM {rows} WHERE is_error) GROUP BY ALL),
peaks AS (SELECT unit, value, count FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY count DESC, value) AS r FROM pk) WHERE r <= CASE WHEN unit = 'hour' THEN 3 ELSE 2 END)"""


def _state(rows: str) -> str:
    return f"""tr AS (SELECT service, coalesce(regr_slope(CAST(errors AS DOUBLE), CAST(i AS DOUBLE)) / nullif(avg(errors), 0), 0) AS slope, count(*) AS k FROM ser GROUP BY service),
state AS (SELECT service, requests, error_rate, p95, slope, CASE WHEN k < 3 THEN 'stable' WHEN slope > 0.3 THEN 'increasing' WHEN slope < -0.3 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT service, count(*) AS requests, count(*) FILTER (WHERE is_error) * 100.0 / count(*) AS error_rate, quantile_cont(duration_ms, 0.95) AS p95 FROM {rows} GROUP BY service) JOIN tr USING (service))"""


_SIGNALS = """lg AS (SELECT service, i, max(i) OVER (PARTITION BY service) AS z, unnest(['error_rate_anomaly', 'latency_anomaly', 'traffic_anomaly']) AS signal, unnest([CAST(error_rate AS DOUBLE), CAST(latency AS DOUBLE), CAST(requests AS DOUBLE)]) AS value FROM ser),
bl AS (SELECT service, signal, avg(value) FILTER (WHERE i <= z - 2) AS baseline, stddev_pop(value) FILTER (WHERE i <= z - 2) AS std, max(value) FILTER (WHERE i = z) AS value FROM lg WHERE z >= 4 GROUP BY ALL),
sg AS (SELECT *, least(1.0, coalesce(abs(value - baseline) / nullif(std, 0), 0) / 3) AS score, coalesce((value - baseline) * 100 / nullif(baseline, 0), 0) AS change FROM bl),
signals AS (SELECT service, signal, CASE WHEN CASE signal WHEN 'error_rate_anomaly' THEN score > 0.8 WHEN 'latency_anomaly' THEN value - baseline > 50 ELSE abs(change) > 100 END THEN 'high' ELSE 'medium' END AS severity, score, value, baseline, CASE WHEN signal <> 'traffic_anomaly' THEN 'increasing' WHEN change > 0 THEN 'spiking' ELSE 'dropping' END AS direction
FROM sg WHERE score > 0.4 AND CASE signal WHEN 'error_rate_anomaly' THEN value > 1 WHEN 'latency_anomaly' THEN value - baseline > 25 ELSE abs(change) > 50 END)"""

_PAST = f"{SPANS}, past AS (SELECT * FROM spans WHERE start_ts < TIMESTAMP '{NOW}')"
_WARNED = f"{_PAST}, {_series('past')}, {_SIGNALS}"


@query("z1_failure_patterns", f"WITH {SPANS}, {_patterns('spans', 3)} SELECT pattern, service, round(strength, 4) AS strength, severity FROM patterns")
def _(spark, sf):
    return rounded(D.failure_patterns(spans(spark, sf), MONTH, 3), "strength")


@query("z1_failure_peaks", f"WITH {SPANS}, {_peaks('spans')} SELECT * FROM peaks")
def _(spark, sf):
    return D.failure_peaks(spans(spark, sf))


@query("z2_service_state", f"WITH {SPANS}, {_series('spans')}, {_state('spans')} SELECT service, requests, round(error_rate, 4) AS error_rate, round(p95, 4) AS p95, round(slope, 5) AS slope, trend FROM state")
def _(spark, sf):
    return rounded(rounded(D.service_state(spans(spark, sf), MONTH), "error_rate", "p95"), "slope", digits=5)


@query("z2_load_and_health", f"""WITH {SPANS}, {_series('spans')}, {_state('spans')}, lb AS (SELECT time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS b, count(*) AS n FROM spans GROUP BY 1),
le AS (SELECT lo + k * INTERVAL '30 days' AS b FROM (SELECT min(b) AS lo, CAST(round((epoch(max(b)) - epoch(min(b))) / 2592000) AS BIGINT) AS m FROM lb), LATERAL (SELECT unnest(range(0, m + 1)) AS k)), ll AS (SELECT b, coalesce(n, 0) AS n, row_number() OVER (ORDER BY b) AS i FROM le LEFT JOIN lb USING (b)),
lo AS (SELECT arg_max(n, i) / 2592000.0 AS rate, coalesce(regr_slope(CAST(n AS DOUBLE), CAST(i AS DOUBLE)) / nullif(avg(n), 0), 0) AS slope FROM ll), h AS (SELECT avg(error_rate) AS e, count(*) FILTER (WHERE p95 > 2000) AS slow, count(*) FILTER (WHERE trend = 'increasing' AND error_rate > 0.5) AS rising FROM state)
SELECT round(rate, 8) AS rate, round(slope, 5) AS slope, CASE WHEN slope > 0.5 THEN 'spiking' WHEN slope > 0.2 THEN 'increasing' WHEN slope < -0.2 THEN 'decreasing' ELSE 'stable' END AS trend, round(greatest(0.0, 100 - CASE WHEN e > 1 THEN least(30.0, e * 5) ELSE 0.0 END - least(20, slow * 5) - least(20, rising * 10)), 4) AS health FROM lo, h""")
def _(spark, sf):
    df = spans(spark, sf)
    one = D.load_state(df, MONTH).crossJoin(F.broadcast(D.overall_health(D.service_state(df, MONTH))))
    return rounded(rounded(rounded(one, "rate", digits=8), "slope", digits=5), "health")


@query("z3_warning_signals", f"WITH {_WARNED} SELECT service, signal, severity, round(score, 4) AS score, round(value, 4) AS value, round(baseline, 4) AS baseline, direction FROM signals")
def _(spark, sf):
    return rounded(D.warning_signals(past(spark, sf), MONTH, "high"), "score", "value", "baseline")


_EXHAUSTED = f"""{METRICS}, rb AS (SELECT metric, time_bucket(INTERVAL '1 hour', ts) AS b, avg(value) AS v FROM metrics WHERE metric IN ('view', 'click', 'purchase') GROUP BY ALL HAVING avg(value) > 0), rg AS (SELECT metric, arg_min(v, b) AS f, arg_max(v, b) AS c, count(*) AS n FROM rb GROUP BY metric HAVING count(*) >= 3),
rh AS (SELECT *, (c - f) / (n - 1) AS per, CASE metric WHEN 'purchase' THEN 300 ELSE 500 END AS lim FROM rg), exhausted AS (SELECT metric, c AS current, least(100.0, c + per * 24) AS projected, CASE WHEN per > 0 AND c < lim THEN (lim - c) / per END AS hours_left FROM rh), ex AS (SELECT *, CASE WHEN hours_left < 300 THEN 'critical' WHEN hours_left < 2000 THEN 'high' END AS severity FROM exhausted)"""


@query("z4_exhaustion", f"WITH {_EXHAUSTED} SELECT metric, round(current, 4) AS current, round(projected, 4) AS projected, round(hours_left, 2) AS hours_left, severity FROM ex")
def _(spark, sf):
    return rounded(rounded(D.exhaustion(metrics(spark, sf), LIMITS, 3600), "current", "projected"), "hours_left", digits=2)


_OWN = f"""{_WARNED}, {_state('past')}, hs AS (SELECT service, avg(e) FILTER (WHERE r <= 6) AS recent, count(*) AS buckets FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY b DESC) AS r FROM pb WHERE e > 0) GROUP BY service), wn AS (SELECT service, count(*) AS signals, sum(CASE severity WHEN 'high' THEN 0.2 ELSE 0.1 END) AS weight FROM signals GROUP BY service),
own AS (SELECT service, least(1.0, 1.3 * (CASE WHEN error_rate > 5 THEN 0.3 WHEN error_rate > 2 THEN 0.2 WHEN error_rate > 1 THEN 0.1 ELSE 0 END + coalesce(weight, 0) + CASE WHEN trend = 'increasing' THEN 0.15 ELSE 0 END + CASE WHEN recent > 10 THEN 0.2 WHEN recent > 5 THEN 0.1 ELSE 0 END)) AS probability, coalesce(signals, 0) AS signals, coalesce(buckets, 0) AS buckets FROM state LEFT JOIN wn USING (service) LEFT JOIN hs USING (service))"""
#: A fixed number of rounds, far beyond what the tolerance needs.
_SPREAD = _OWN.replace("WITH ", "", 1) + """, ed AS (SELECT p.service AS source, c.service AS target, count(*) AS calls FROM past c JOIN past p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.service <> c.service GROUP BY ALL), wt AS (SELECT source, target, 0.5 * calls / sum(calls) OVER (PARTITION BY source) AS w FROM ed),
rounds AS (SELECT 0 AS k, service, CAST(probability AS DOUBLE) AS own, CAST(probability AS DOUBLE) AS p FROM own
UNION ALL SELECT k + 1, service, own, 1 - (1 - own) * coalesce((SELECT exp(sum(ln(1 - w * c.p))) FROM wt JOIN rounds c ON c.service = wt.target WHERE wt.source = rounds.service), 1) FROM rounds WHERE k < 40), spread AS (SELECT service, own, p AS probability FROM rounds WHERE k = 40)"""
_SPREAD = _SPREAD.replace("coalesce((SELECT exp(sum(ln(1 - w * c.p))) FROM wt JOIN rounds c ON c.service = wt.target WHERE wt.source = rounds.service), 1) FROM rounds WHERE k < 40", "coalesce(exp(sum(ln(1 - w * c.p))), 1) FROM (SELECT r.k, r.service, r.own, w, x.p FROM rounds r LEFT JOIN wt ON wt.source = r.service LEFT JOIN rounds x ON x.service = wt.target) c WHERE k < 40 GROUP BY k, service, own")


def own(spark, sf, df):
    series = D.service_series(df, MONTH)
    return cut_lineage(D.own_probability(D.service_state(df, MONTH), D.warning_signals(df, MONTH, "high"), series, "high"))


@query("z4_own_probability", f"WITH {_OWN} SELECT service, round(probability, 4) AS probability, signals, buckets FROM own")
def _(spark, sf):
    return rounded(own(spark, sf, past(spark, sf)), "probability")


@query("z4_cascade", f"WITH RECURSIVE {_SPREAD} SELECT service, round(own, 4) AS own, round(probability, 4) AS probability FROM spread")
def _(spark, sf):
    df = past(spark, sf)
    return rounded(D.cascade(own(spark, sf, df), G.dependency_edges(df)), "own", "probability")


_FOUND = f"""{_SPREAD}, {_patterns('past', 3)}, {_peaks('past')}, {_EXHAUSTED},
found AS (SELECT 'service_failure' AS kind, service, CAST(NULL AS VARCHAR) AS detail, CAST(probability AS DOUBLE) AS probability, CASE WHEN probability > 0.8 THEN '0-2 hours' WHEN probability > 0.6 THEN '2-6 hours' WHEN probability > 0.4 THEN '6-12 hours' ELSE '12-24 hours' END AS timeframe, CASE WHEN probability > 0.8 THEN 1 WHEN probability > 0.6 THEN 4 WHEN probability > 0.4 THEN 9 ELSE 18 END AS hour,
  CASE WHEN probability > 0.7 THEN 'critical' WHEN probability > 0.5 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN signals > 3 AND buckets > 20 THEN 'high' WHEN signals > 1 AND buckets > 10 THEN 'medium' ELSE 'low' END AS confidence FROM own WHERE probability > 0.3
UNION ALL SELECT 'cascading_failure', service, 'callees', probability, CASE WHEN probability > 0.8 THEN '0-2 hours' WHEN probability > 0.6 THEN '2-6 hours' WHEN probability > 0.4 THEN '6-12 hours' ELSE '12-24 hours' END, CASE WHEN probability > 0.8 THEN 1 WHEN probability > 0.6 THEN 4 WHEN probability > 0.4 THEN 9 ELSE 18 END, CASE WHEN probability > 0.7 THEN 'critical' WHEN probability > 0.5 THEN 'high' ELSE 'medium' END, 'medium' FROM spread WHERE probability > 0.3 AND own <= 0.3
UNION ALL SELECT 'resource_exhaustion', NULL, metric, CASE WHEN hours_left < 6 THEN 0.9 ELSE 0.7 END, printf('%.1f hours', hours_left), floor(hours_left), severity, 'high' FROM ex WHERE severity IS NOT NULL AND hours_left < 500
UNION ALL SELECT 'cascading_failure', NULL, 'trend', 0.6, '6-12 hours', 9, 'high', 'medium' FROM patterns WHERE pattern = 'increasing_failures' AND strength > 0.5
UNION ALL SELECT 'periodic_failure', NULL, concat(value, ':00'), 0.5, concat((value - {HOUR} + 24) % 24, ' hours'), (value - {HOUR} + 24) % 24, 'medium', 'medium' FROM peaks WHERE unit = 'hour' AND (value - {HOUR} + 24) % 24 > 0)"""


def found(spark, sf):
    df = past(spark, sf)
    mine = own(spark, sf, df)
    return D.predictions(mine, D.cascade(mine, G.dependency_edges(df)), D.exhaustion(metrics(spark, sf), LIMITS, 3600), D.failure_patterns(df, MONTH, 3), D.failure_peaks(df), HOUR, 500)


@query("z4_predictions", f"WITH RECURSIVE {_FOUND} SELECT kind, service, detail, round(probability, 4) AS probability, timeframe, CAST(hour AS DOUBLE) AS hour, severity, confidence FROM found")
def _(spark, sf):
    return rounded(found(spark, sf), "probability")


@query("z5_probability_rollup", f"""WITH RECURSIVE {_FOUND}, k AS (SELECT unnest(['horizon', 'service', 'kind']) AS "by", unnest([CASE WHEN timeframe = '0-2 hours' THEN 'immediate' WHEN timeframe IN ('2-6 hours', '6-12 hours') THEN 'short' WHEN timeframe = '12-24 hours' THEN 'medium' END, service, kind]) AS name, probability FROM found) SELECT "by", name, round(max(probability), 4) AS probability, count(*) AS predictions FROM k WHERE name IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return rounded(D.probability_rollup(found(spark, sf)), "probability")


@query("z5_risk_timeline", f"WITH RECURSIVE {_FOUND}, g AS (SELECT floor(hour / 6) * 6 AS start, max(probability) AS p, count(*) AS n FROM found GROUP BY 1), w AS (SELECT x.start, coalesce(p, 0) AS p, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 24, 6)) AS start) x LEFT JOIN g ON g.start = x.start) SELECT start, round(p, 4) AS probability, n AS predictions, CASE WHEN p > 0.7 THEN 'critical' WHEN p > 0.5 THEN 'high' WHEN p > 0.3 THEN 'medium' ELSE 'low' END AS risk FROM w")
def _(spark, sf):
    return rounded(D.risk_timeline(found(spark, sf)), "probability")


@query("z5_causes", f"""WITH RECURSIVE {_FOUND} SELECT service, CASE signal WHEN 'error_rate_anomaly' THEN 'primary' ELSE 'contributing' END AS role, CASE signal WHEN 'error_rate_anomaly' THEN 'Error rate anomaly' ELSE 'Performance degradation' END AS cause, round(score, 4) AS evidence FROM signals WHERE signal <> 'traffic_anomaly' AND service IN (SELECT service FROM found WHERE kind = 'service_failure')
UNION ALL SELECT NULL, 'primary', concat(detail, ' exhaustion'), probability FROM found WHERE kind = 'resource_exhaustion'""")
def _(spark, sf):
    return rounded(D.failure_causes(found(spark, sf), D.warning_signals(past(spark, sf), MONTH, "high")), "evidence")
