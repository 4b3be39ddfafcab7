"""Queries of cost courses, retry causes, service changes, rare templates, periods and attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.operators import anomaly as X
from tracelake.operators import composites as K
from tracelake.operators import courses as U
from tracelake.operators import graph as G
from tracelake.operators import reports as P
from tracelake.operators import series as R
from tracelake.plans.fixtures import LOGS, SPANS, logs, spans
from tracelake.plans.q_incident import _STORMS
from tracelake.plans.q_logs import A
from tracelake.plans.q_series import _series, six_hours
from tracelake.plans.registry import query

S6 = _series(21600)


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


_COSTS = f"{SPANS}, cb AS (SELECT time_bucket(INTERVAL '1 day', start_ts) AS bucket, CAST(sum(duration_ms) AS DOUBLE) / 3600000 * 0.2 + count(DISTINCT trace_id) / 1e6 * 0.2 AS cost FROM spans GROUP BY 1), costs AS (SELECT *, row_number() OVER (ORDER BY bucket) - 1 AS i FROM cb)"


@query("v3_cost_profile", f"WITH {_COSTS}, u AS (SELECT unnest(['hour', 'weekday']) AS unit, unnest([CAST(hour(bucket) AS INT), CAST(isodow(bucket) AS INT)]) AS value, cost FROM costs) SELECT unit, value, round(avg(cost), 6) AS mean, count(*) AS buckets, round(avg(cost) / (SELECT avg(cost) FROM costs), 5) AS factor FROM u GROUP BY unit, value")
def _(spark, sf):
    return rounded(rounded(U.cost_profile(U.bucket_costs(spans(spark, sf))), "mean", digits=6), "factor", digits=5)


@query("v3_cost_peaks", f"WITH {_COSTS} SELECT bucket, round(cost, 6) AS cost, round(cost / (SELECT avg(cost) FROM costs), 5) AS factor FROM costs ORDER BY costs.cost DESC, bucket LIMIT 5")
def _(spark, sf):
    return rounded(rounded(U.cost_peaks(U.bucket_costs(spans(spark, sf))), "cost", digits=6), "factor", digits=5)


@query("v6_cost_trend", f"""WITH {_COSTS}, z AS (SELECT max(i) AS z, regr_slope(cost, CAST(i AS DOUBLE)) / avg(cost) AS slope, arg_max(cost, i) AS last FROM costs), g AS (SELECT any_value(slope) AS slope, any_value(last) AS last, avg(cost) FILTER (WHERE z - i < 7) AS recent, avg(cost) FILTER (WHERE z - i >= 7 AND z - i < 14) AS previous FROM costs, z), c AS (SELECT *, (recent - previous) * 100 / previous AS change FROM g)
SELECT round(recent, 6) AS recent, round(previous, 6) AS previous, round(change, 4) AS change, CASE WHEN change > 5 THEN 'increasing' WHEN change < -5 THEN 'decreasing' ELSE 'stable' END AS direction, round(slope, 8) AS slope, round(last * (1 + slope * 30), 6) AS forecast, CASE WHEN abs(slope) < 0.1 THEN 'high' ELSE 'medium' END AS confidence FROM c""")
def _(spark, sf):
    out = U.cost_trend(U.bucket_costs(spans(spark, sf)))
    return rounded(rounded(rounded(out, "recent", "previous", "forecast", digits=6), "change"), "slope", digits=8)


@query("q4_retry_root_causes", f"""WITH {_STORMS}, rows AS (SELECT *, CASE WHEN error_type = 'Memory' THEN 503 WHEN error_type = 'Connection' AND line = 3 THEN 429 ELSE 200 END AS code FROM spans SEMI JOIN storms USING (service, operation)), per AS (SELECT service, operation, error_type, count(*) AS n FROM rows WHERE error_type IS NOT NULL GROUP BY ALL), top AS (SELECT service, operation, arg_max(error_type, (n, error_type)) AS t, max(n) AS n FROM per GROUP BY ALL),
f AS (SELECT service, operation, 'primary' AS role, CASE WHEN contains(lower(t), 'timeout') THEN 'timeout' WHEN contains(lower(t), 'connection') THEN 'connection_failure' END AS cause, n AS evidence, 'high' AS severity FROM top UNION ALL SELECT service, operation, 'primary', 'rate_limiting', count(*), 'critical' FROM rows WHERE code = 429 GROUP BY ALL UNION ALL SELECT service, operation, 'contributing', 'server_errors', count(*), 'medium' FROM rows WHERE code >= 500 GROUP BY ALL)
SELECT service, operation, role, cause, evidence, severity, role = 'primary' AND count(*) OVER (PARTITION BY role, cause) > 2 AS common FROM f WHERE cause IS NOT NULL""")
def _(spark, sf):
    df = spans(spark, sf)
    code = F.when(F.col("error_type") == "Memory", 503).when((F.col("error_type") == "Connection") & (F.col("line") == 3), 429).otherwise(200)
    return U.retry_root_causes(df, P.retry_storms(df, F.col("line") % 2 == 1, least=10, least_ratio=1.0), code)


@query("g39_service_changes", f"WITH {SPANS}, c AS (SELECT p.service AS source, c.service AS target, c.start_ts AS ts FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.service <> c.service AND (p.service <> 'gateway' OR c.start_ts < TIMESTAMP '1998-01-01')), a AS (SELECT DISTINCT unnest([source, target]) AS service FROM c WHERE ts >= TIMESTAMP '1998-01-01'), b AS (SELECT DISTINCT unnest([source, target]) AS service FROM c WHERE ts < TIMESTAMP '1998-01-01') SELECT service, 'added' AS state FROM (FROM a EXCEPT FROM b) UNION ALL SELECT service, 'removed' FROM (FROM b EXCEPT FROM a)")
def _(spark, sf):
    """Services of the calls before and after a day from which the gateway makes none."""
    calls, day = G.calls(spans(spark, sf)), F.lit("1998-01-01").cast("timestamp_ntz")
    return U.service_changes(calls.filter((F.col("start_ts") >= day) & (F.col("source") != "gateway")), calls.filter(F.col("start_ts") < day))


@query("t7_rare_templates", f"WITH {LOGS}, p AS (SELECT {A} AS template, count(*) AS count, count(*) FILTER (WHERE level = 'error') AS errors FROM logs GROUP BY 1), s AS (SELECT *, count / CAST((SELECT count(*) FROM logs) AS DOUBLE) AS share FROM p) SELECT template, count, errors, round(share, 6) AS share FROM s WHERE share < 0.2005 AND count >= 2 ORDER BY errors > 0 DESC, count, template LIMIT 50")
def _(spark, sf):
    return rounded(U.rare_templates(logs(spark, sf), C.template_a(F.col("message")), 0.2005), "share", digits=6)


@query("r12_periodicity", f"WITH {S6}, d AS (SELECT metric, i, value - avg(value) OVER (PARTITION BY metric) AS d, var_pop(value) OVER (PARTITION BY metric) AS v FROM s), l AS (SELECT unnest([24, 12, 8, 6]) AS lag), x AS (SELECT a.metric, lag, avg(a.d * b.d) / max(a.v) AS c FROM d a CROSS JOIN l LEFT JOIN d b ON b.metric = a.metric AND b.i = a.i - lag GROUP BY ALL) SELECT metric, lag, round(coalesce(c, 0), 6) AS correlation, coalesce(c, 0) > 0.7 AS seasonal FROM x")
def _(spark, sf):
    return rounded(R.autocorrelation(six_hours(spark, sf), ["metric"], (24, 12, 8, 6), 0.7), "correlation", digits=6)


@query("x1e_seasonal_anomalies", f"WITH {S6}, a AS (SELECT metric, i, value - avg(value) OVER (PARTITION BY metric, i % 4) + avg(value) OVER (PARTITION BY metric) AS value FROM s), z AS (SELECT metric, i, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY metric)) SELECT metric, i, round(z, 6) AS z, CASE WHEN z > 0 THEN 'spike' ELSE 'dip' END AS kind FROM z WHERE n >= 30 AND abs(z) > 2.0")
def _(spark, sf):
    return rounded(X.detect_anomalies(six_hours(spark, sf), ["metric"], period=4).select("metric", "i", "z", "kind"), "z", digits=6)


@query("n5_attribute_values", f"WITH {SPANS}, l AS (SELECT unnest(['operation', 'error', 'line']) AS key, unnest([operation, error_type, CAST(line AS VARCHAR)]) AS value FROM spans), p AS (SELECT key, value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT key, CAST(sum(count) OVER (PARTITION BY key) AS BIGINT) AS \"rows\", count(*) OVER (PARTITION BY key) AS \"values\", value, count, CAST(row_number() OVER (PARTITION BY key ORDER BY count DESC, value) AS INT) AS rank FROM p) SELECT * FROM r WHERE rank <= 10")
def _(spark, sf):
    df = spans(spark, sf).select(F.create_map(F.lit("operation"), F.col("operation"), F.lit("error"), F.col("error_type"), F.lit("line"), F.col("line").cast("string")).alias("attributes"))
    return U.attribute_values(df, "attributes")


@query("cp14_signal_pattern", f"WITH {S6}, t AS (SELECT metric, regr_slope(value, CAST(i AS DOUBLE)) AS slope, coalesce(regr_r2(value, CAST(i AS DOUBLE)), 0) AS r2 FROM s GROUP BY metric), o AS (SELECT metric, period, i % period AS k, max(value) - min(value) AS a FROM s, (SELECT unnest([4, 7, 28]) AS period) GROUP BY ALL), b AS (SELECT metric, period, max(a) AS amplitude FROM o GROUP BY ALL), c AS (SELECT metric, arg_max(period, (amplitude, -period)) AS period, max(amplitude) AS amplitude FROM b GROUP BY metric) SELECT metric, round(slope, 6) AS slope, round(r2, 6) AS r2, CASE WHEN abs(slope) <= 0.01 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, CAST(period AS INT) AS period, round(amplitude, 4) AS amplitude FROM t JOIN c USING (metric)")
def _(spark, sf):
    out = K.analyse_signal(six_hours(spark, sf), ["metric"], "pattern", seasons=(4, 7, 28))
    return rounded(rounded(out, "slope", "r2", digits=6), "amplitude")
