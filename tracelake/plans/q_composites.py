"""Queries of whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.operators import composites as K
from tracelake.operators import graph as G
from tracelake.plans.fixtures import LOGS, METRICS, SPANS, logs, metrics, spans, table
from tracelake.plans.q_graph import _BOTH, _CALLS, _SPLIT, _UND, _WALK, halves
from tracelake.plans.q_series import M, S1, S6, daily, six_hours
from tracelake.plans.registry import query


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


_NODES = "nodes AS (SELECT service, count(*) AS requests, avg(duration_ms) AS avg, avg(CAST(is_error AS INT)) AS error_rate FROM spans GROUP BY service)"
_REPORT = _WALK.format(n=5) + f""", {_NODES}, up AS (SELECT target AS service, list_sort(list(source)) AS upstream FROM edges GROUP BY target), down AS (SELECT source AS service, list_sort(list(target)) AS downstream, max(error_rate) AS worst FROM edges GROUP BY source),
through AS (SELECT service, count(*) AS paths FROM (SELECT unnest(path) AS service FROM whole) GROUP BY service),
report AS (SELECT service, requests, avg, error_rate, coalesce(upstream, []) AS upstream, coalesce(downstream, []) AS downstream, coalesce(paths, 0) AS paths, 1 - (0.4 * error_rate + 0.3 * least(avg / 5000, 1.0) + 0.3 * (CAST(error_rate > 0.05 AS INT) + CAST(avg > 1000 AS INT) + CAST(coalesce(worst, 0) > 10 AS INT)) / 10.0) AS health FROM nodes LEFT JOIN up USING (service) LEFT JOIN down USING (service) LEFT JOIN through USING (service))"""


@query("cp1_dependency_report", _REPORT + " SELECT service, requests, round(avg, 4) AS avg, round(error_rate, 6) AS error_rate, array_to_string(upstream, ',') AS upstream, array_to_string(downstream, ',') AS downstream, paths, round(health, 6) AS health FROM report")
def _(spark, sf):
    r = K.dependency_report(spans(spark, sf)).withColumns({c: F.array_join(c, ",") for c in ("upstream", "downstream")})
    return rounded(rounded(r, "avg"), "error_rate", "health", digits=6)


@query("g42_bottleneck_services", _REPORT + " SELECT service, round(least(len(upstream) / 10.0, 1.0) * 0.3 + least(avg / 5000.0, 1.0) * 0.3 + error_rate * 0.2 + least(paths / 10.0, 1.0) * 0.2, 6) AS score, len(upstream) * requests AS incoming_load, len(downstream) * requests AS outgoing_load, round(avg, 4) AS avg, round(error_rate, 6) AS error_rate, paths FROM report WHERE least(len(upstream) / 10.0, 1.0) * 0.3 + least(avg / 5000.0, 1.0) * 0.3 + error_rate * 0.2 + least(paths / 10.0, 1.0) * 0.2 > 0.25")
def _(spark, sf):
    return rounded(rounded(K.bottleneck_services(K.dependency_report(spans(spark, sf)), 0.25), "avg"), "score", "error_rate", digits=6)


@query("cp2_service_graph", f"""WITH RECURSIVE {_UND}, {_NODES}, reach AS (SELECT s, t FROM und UNION SELECT r.s, u.t FROM reach r JOIN und u ON u.s = r.t), lab AS (SELECT s AS service, least(s, min(t)) AS cluster FROM reach GROUP BY s),
g AS (SELECT cluster, count(*) AS size FROM lab GROUP BY cluster), i AS (SELECT cluster, count(*) AS n FROM (SELECT DISTINCT source, target FROM edges) e JOIN lab ON lab.service = e.source GROUP BY cluster),
d AS (SELECT s AS service, count(*) AS n FROM (SELECT source AS s FROM edges UNION ALL SELECT target FROM edges) GROUP BY s)
SELECT service, requests, round(avg, 4) AS avg, round(error_rate, 6) AS error_rate, round(coalesce(d.n, 0) / CAST((SELECT count(*) FROM d) - 1 AS DOUBLE), 6) AS degree, cluster, size, round(i.n / CAST(size * (size - 1) AS DOUBLE), 6) AS cohesion FROM nodes LEFT JOIN lab USING (service) LEFT JOIN g USING (cluster) LEFT JOIN i USING (cluster) LEFT JOIN d USING (service)""")
def _(spark, sf):
    return rounded(rounded(K.service_graph(spans(spark, sf)), "avg"), "error_rate", "degree", "cohesion", digits=6)


_TRACED = f"""WITH {_CALLS}, r AS (SELECT service AS source, '' AS target, trace_id, duration_ms, is_error FROM spans UNION ALL SELECT source, target, trace_id, duration_ms, is_error FROM calls),
k AS (SELECT source, target, trace_id FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY trace_id) AS k FROM (SELECT DISTINCT source, target, trace_id FROM r)) WHERE k <= 10), ids AS (SELECT source, target, string_agg(trace_id, ',' ORDER BY trace_id) AS trace_ids FROM k GROUP BY ALL),
traced AS (SELECT source, target, count(*) AS count, count(*) FILTER (WHERE is_error) AS errors, count(*) FILTER (WHERE is_error) / CAST(count(*) AS DOUBLE) AS error_rate, avg(duration_ms) AS avg, list_sort(list(duration_ms))[least(CAST(floor(0.95 * count(*)) AS BIGINT) + 1, count(*))] AS p95, count(DISTINCT trace_id) AS traces FROM r GROUP BY ALL)"""


@query("cp5_traced_graph", _TRACED + " SELECT source, nullif(target, '') AS target, count, errors, round(error_rate, 6) AS error_rate, round(avg, 4) AS avg, p95, traces, trace_ids FROM traced JOIN ids USING (source, target)")
def _(spark, sf):
    g = K.traced_graph(spans(spark, sf)).withColumn("trace_ids", F.array_join("trace_ids", ","))
    return rounded(rounded(g, "avg"), "error_rate", digits=6)


@query("g40_edge_outliers", _TRACED + """, e AS (SELECT * FROM traced WHERE target <> '' AND count >= 5), m AS (SELECT quantile_cont(error_rate, 0.5) AS a, quantile_cont(avg, 0.5) AS b, quantile_cont(p95, 0.5) AS c FROM e), d AS (SELECT e.*, abs(error_rate - a) AS da, abs(avg - b) AS db, abs(p95 - c) AS dc FROM e, m), q AS (SELECT quantile_cont(da, 0.5) AS a, quantile_cont(db, 0.5) AS b, quantile_cont(dc, 0.5) AS c FROM d),
s AS (SELECT d.*, greatest(coalesce(0.6745 * da / nullif(q.a, 0), 0), coalesce(0.6745 * db / nullif(q.b, 0), 0), coalesce(0.6745 * dc / nullif(q.c, 0), 0)) AS score FROM d, q)
SELECT source, target, CASE WHEN error_rate > 0.1 THEN 'high_error_rate' WHEN p95 > 1000 THEN 'high_latency' ELSE 'unusual_pattern' END AS kind, round(score, 4) AS score, trace_ids FROM s JOIN ids USING (source, target) WHERE score > 1.5""")
def _(spark, sf):
    e = K.edge_outliers(spans(spark, sf), t=1.5)
    return rounded(e.select("source", "target", "kind", "score", F.array_join("trace_ids", ",").alias("trace_ids")), "score")


@query("g36_unusual_changes", _SPLIT + """, j AS (SELECT source, target, c.n AS c, b.n AS b, coalesce((c.n - b.n) / CAST(b.n AS DOUBLE), 0) AS change, coalesce(c.e - b.e, 0) AS error_change FROM c FULL OUTER JOIN b USING (source, target)),
k AS (SELECT *, abs(coalesce(c, 0) - coalesce(b, 0)) AS difference, CASE WHEN b IS NULL AND c >= 10 THEN 'new' WHEN c IS NULL AND b >= 10 THEN 'removed' WHEN b IS NOT NULL AND c IS NOT NULL AND greatest(b, c) >= 10 AND abs(change) >= 0.25 THEN 'traffic_change' WHEN b IS NOT NULL AND c IS NOT NULL AND greatest(b, c) >= 10 AND abs(error_change) >= 0.05 THEN 'error_rate_change' END AS kind FROM j), x AS (SELECT * FROM k WHERE kind IS NOT NULL),
m AS (SELECT quantile_cont(difference, 0.5) AS a, quantile_cont(change, 0.5) AS b, quantile_cont(error_change, 0.5) AS c, quantile_cont(CAST(kind = 'new' AS DOUBLE), 0.5) AS n, quantile_cont(CAST(kind = 'removed' AS DOUBLE), 0.5) AS r, quantile_cont(CAST(kind = 'traffic_change' AS DOUBLE), 0.5) AS t, quantile_cont(CAST(kind = 'error_rate_change' AS DOUBLE), 0.5) AS e FROM x),
d AS (SELECT source, target, kind, abs(difference - m.a) AS da, abs(change - m.b) AS db, abs(error_change - m.c) AS dc, abs(CAST(kind = 'new' AS DOUBLE) - n) AS dn, abs(CAST(kind = 'removed' AS DOUBLE) - r) AS dr, abs(CAST(kind = 'traffic_change' AS DOUBLE) - t) AS dt, abs(CAST(kind = 'error_rate_change' AS DOUBLE) - e) AS de FROM x, m),
q AS (SELECT quantile_cont(da, 0.5) AS a, quantile_cont(db, 0.5) AS b, quantile_cont(dc, 0.5) AS c, quantile_cont(dn, 0.5) AS n, quantile_cont(dr, 0.5) AS r, quantile_cont(dt, 0.5) AS t, quantile_cont(de, 0.5) AS e FROM d),
s AS (SELECT source, target, kind, greatest(coalesce(0.6745 * da / nullif(q.a, 0), 0), coalesce(0.6745 * db / nullif(q.b, 0), 0), coalesce(0.6745 * dc / nullif(q.c, 0), 0), coalesce(0.6745 * dn / nullif(q.n, 0), 0), coalesce(0.6745 * dr / nullif(q.r, 0), 0), coalesce(0.6745 * dt / nullif(q.t, 0), 0), coalesce(0.6745 * de / nullif(q.e, 0), 0)) AS score FROM d, q)
SELECT source, target, kind, round(score, 4) AS score FROM s WHERE score > 1""")
def _(spark, sf):
    return rounded(K.unusual_changes(G.edge_changes(*halves(spark, sf)), t=1.0).select("source", "target", "kind", "score"), "score")


@query("cp7_g36_change_wording")
def _(spark, sf):
    return K.unusual_changes(G.edge_changes(*halves(spark, sf)), method="text", t=0.99).select("source", "target", "text")


@query("cp8_span_report", f"""WITH {SPANS}, r AS (SELECT * FROM spans WHERE contains(lower(service), 'svc') AND duration_ms >= 50), b AS (SELECT count(*) AS count, avg(duration_ms) AS avg, quantile_disc(duration_ms, 0.95) AS p95, avg(CAST(is_error AS INT)) AS error_rate FROM r), p AS (SELECT quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99 FROM r),
x AS (SELECT duration_ms, concat_ws(', ', CASE WHEN duration_ms > p99 THEN 'above p99' END, CASE WHEN duration_ms > p95 AND duration_ms <= p99 THEN 'above p95' END, CASE WHEN is_error THEN 'error' END) AS reasons FROM r, p),
u AS (SELECT 'overall' AS section, 'all' AS name, count, avg, p95, error_rate FROM b UNION ALL SELECT 'operation', concat_ws(':', service, operation), count(*), avg(duration_ms), quantile_disc(duration_ms, 0.95), avg(CAST(is_error AS INT)) FROM r GROUP BY service, operation UNION ALL SELECT 'bottleneck', reasons, count(*), avg(duration_ms), NULL, NULL FROM x WHERE reasons <> '' GROUP BY reasons)
SELECT section, name, count, round(avg, 4) AS avg, p95, round(error_rate, 6) AS error_rate FROM u""")
def _(spark, sf):
    return rounded(rounded(K.span_report(spans(spark, sf), service="svc", least_ms=50.0), "avg"), "error_rate", digits=6)


@query("cp9_attribute_report", f"""WITH {SPANS}, p AS (SELECT 'operation' AS key, operation AS value FROM spans UNION ALL SELECT 'service', service FROM spans UNION ALL SELECT 'error', error_type FROM spans WHERE error_type IS NOT NULL), c AS (SELECT key, value, count(*) AS count FROM p GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY count DESC, value) AS rank FROM c)
SELECT 'value' AS section, key AS name, value, count FROM k WHERE rank <= 10 UNION ALL SELECT 'keys', CASE WHEN error_type IS NULL THEN 'operation,service' ELSE 'error,operation,service' END, NULL, count(*) FROM spans GROUP BY 2""")
def _(spark, sf):
    own = F.create_map(F.lit("operation"), "operation", F.lit("service"), "service", F.lit("error"), "error_type")
    return K.attribute_report(spans(spark, sf).withColumn("attributes", F.map_filter(own, lambda k, v: v.isNotNull())))


_TURNS = "turns AS (SELECT role AS key, text AS value FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL)"


def turns(spark, sf):
    rows = table(spark, sf, "conversations").filter("role is not null and text is not null")
    return rows.select(F.create_map("role", "text").alias("attributes"))


def _moods() -> str:
    score = " + ".join([f"CAST(contains(lower(value), '{w}') AS INT)" for w in C.POSITIVE]) + " - " + " - ".join([f"CAST(contains(lower(value), '{w}') AS INT)" for w in C.NEGATIVE])
    return f"s AS (SELECT *, {score} AS s FROM turns)"


@query("n10_attribute_text_profile", f"WITH {_TURNS}, {_moods()} SELECT key, count(*) AS count, count(DISTINCT value) AS unique_values, count(*) FILTER (WHERE s > 1) AS positive, count(*) FILTER (WHERE s BETWEEN -1 AND 1) AS neutral, count(*) FILTER (WHERE s < -1) AS negative, CAST(sum(len(regexp_extract_all(value, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'))) AS BIGINT) AS email, CAST(sum(len(regexp_extract_all(value, 'https?://[^ \\t\\n\\f\\r\\x0b]+'))) AS BIGINT) AS url FROM s GROUP BY key")
def _(spark, sf):
    return K.attribute_text_profile(turns(spark, sf)).select("key", "count", "unique_values", "positive", "neutral", "negative", "email", "url")


_RULES = {"question": ("?", "how", "what", "why"), "thanks": ("thank", "please"), "trouble": ("error", "fail", "problem", "wrong")}


def _hits(words) -> str:
    return " + ".join(f"CAST(contains(lower(value), '{w}') AS INT)" for w in words)


@query("n11_attribute_text_categories", f"""WITH {_TURNS}, h AS (SELECT key, {', '.join(f'{_hits(w)} AS {k}' for k, w in _RULES.items())} FROM turns), b AS (SELECT key, CASE WHEN question + thanks + trouble = 0 THEN 'other' WHEN question = greatest(question, thanks, trouble) THEN 'question' WHEN thanks = greatest(question, thanks, trouble) THEN 'thanks' ELSE 'trouble' END AS label, coalesce(greatest(question, thanks, trouble) / CAST(nullif(question + thanks + trouble, 0) AS DOUBLE), 0) AS score FROM h)
SELECT key, label, count(*) AS count, round(avg(score), 6) AS mean_score, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY key) AS DOUBLE), 6) AS share FROM b GROUP BY key, label""")
def _(spark, sf):
    return rounded(K.attribute_text_categories(turns(spark, sf), _RULES), "mean_score", "share", digits=6)


_SERIES = """, st AS (SELECT metric, count(*) AS points, avg(value) AS mean, stddev_pop(value) AS std FROM s GROUP BY metric),
sm AS (SELECT metric, i, avg(value) OVER (PARTITION BY metric ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM s), tr AS (SELECT metric, regr_slope(v, CAST(i AS DOUBLE)) AS slope FROM sm GROUP BY metric),
o AS (SELECT metric, period, max(d) AS amplitude FROM (SELECT metric, period, i % period AS o, max(value) - min(value) AS d FROM s, (SELECT unnest([24, 7, 30]) AS period) GROUP BY ALL) GROUP BY ALL), se AS (SELECT metric, arg_max(period, (amplitude, -period)) AS period, max(amplitude) AS amplitude FROM o GROUP BY metric),
f AS (SELECT metric, i, avg(value) OVER a AS m0, stddev_pop(value) OVER a AS s0, count(*) OVER a AS n0, avg(value) OVER b AS m1, stddev_pop(value) OVER b AS s1, count(*) OVER b AS n1 FROM s WINDOW a AS (PARTITION BY metric ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY metric ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
ch AS (SELECT metric, count(*) AS changes FROM f WHERE n0 = 10 AND n1 = 10 AND (abs(m1 - m0) > 2 * s0 OR s1 / s0 > 2 OR s1 / s0 < 0.5) GROUP BY metric),
an AS (SELECT metric, count(*) AS anomalies FROM (SELECT metric, abs(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY metric ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE n = 5 AND z > 3 GROUP BY metric)
SELECT metric, points, round(mean, 4) AS mean, round(std, 4) AS std, round(slope, 5) AS slope, period, round(amplitude, 4) AS amplitude, coalesce(changes, 0) AS changes, coalesce(anomalies, 0) AS anomalies FROM st JOIN tr USING (metric) JOIN se USING (metric) LEFT JOIN ch USING (metric) LEFT JOIN an USING (metric)"""


@query("cp10_cp13_metric_report", f"WITH {S6}{_SERIES}")
def _(spark, sf):
    r = K.series_report(six_hours(spark, sf), M).select("metric", "points", "mean", "std", "slope", "period", "amplitude", "changes", "anomalies")
    return rounded(rounded(r, "mean", "std", "amplitude"), "slope", digits=5)


@query("cp11_log_report", f"WITH {LOGS}, s AS (SELECT level AS metric, ts, value, row_number() OVER (PARTITION BY level ORDER BY ts) - 1 AS i FROM (SELECT level, time_bucket(INTERVAL '6 hours', ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM logs GROUP BY ALL)){_SERIES.replace('SELECT metric, points', 'SELECT metric AS level, points')}")
def _(spark, sf):
    from tracelake.operators import series as R

    s = R.to_series(logs(spark, sf), "ts", F.count("*"), 21600, ["level"], None)
    r = K.series_report(s, ["level"]).select("level", "points", "mean", "std", "slope", "period", "amplitude", "changes", "anomalies")
    return rounded(rounded(r, "mean", "std", "amplitude"), "slope", digits=5)


@query("cp12_range_histograms", f"WITH {METRICS}, b AS (SELECT metric, ts < TIMESTAMP '2024-01-15 00:00:00' AS early, floor(value / 50) * 50 AS bucket, count(*) AS count, avg(value) AS mean FROM metrics GROUP BY ALL) SELECT metric, early, bucket, count, round(mean, 6) AS mean, round(count / CAST(sum(count) OVER (PARTITION BY metric, early) AS DOUBLE), 6) AS share FROM b")
def _(spark, sf):
    rows = metrics(spark, sf).withColumn("early", F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return rounded(K.range_histogram(rows, "value", 50.0, ["metric", "early"]).withColumn("bucket", F.col("bucket").cast("double")), "mean", "share", digits=6)


@query("cp14_signal_anomalies", f"WITH {S6}, z AS (SELECT metric, i, (value - avg(value) OVER (PARTITION BY metric)) / stddev_pop(value) OVER (PARTITION BY metric) AS z FROM s) SELECT metric, i, round(least(abs(z) / 4, 1), 6) AS score, least(abs(z) / 4, 1) > 0.7 AS is_anomaly FROM z WHERE abs(z) > 2")
def _(spark, sf):
    return rounded(K.analyse_signal(six_hours(spark, sf), M, "anomaly").select("metric", "i", "score", "is_anomaly"), "score", digits=6)


@query("cp14_signal_forecast", f"WITH {S1}, m AS (SELECT metric, arg_max(value, i) AS l, regr_slope(value, CAST(i AS DOUBLE)) AS b FROM s GROUP BY metric) SELECT metric, CAST(k AS INT) AS k, round(l + b * k, 4) AS forecast, round(l + b * k - abs(l + b * k) * 0.1, 4) AS lower, round(l + b * k + abs(l + b * k) * 0.1, 4) AS upper FROM m, (SELECT unnest(range(1, 8)) AS k)")
def _(spark, sf):
    bare = K.analyse_signal(daily(spark, sf), M, "forecast").select("metric", "k", "forecast")
    return rounded(K.banded(bare), "forecast", "lower", "upper")


@query("cp23_severity_counts", f"WITH {SPANS}, m AS (SELECT service, avg(duration_ms) AS m, stddev_pop(duration_ms) AS s FROM spans GROUP BY service), c AS (SELECT service, CASE WHEN abs((duration_ms - m) / s) > 5 THEN 'critical' WHEN abs((duration_ms - m) / s) > 4 THEN 'high' WHEN abs((duration_ms - m) / s) > 3 THEN 'medium' ELSE 'low' END AS c FROM spans JOIN m USING (service)) SELECT service, count(*) FILTER (WHERE c = 'critical') AS critical, count(*) FILTER (WHERE c = 'high') AS high, count(*) FILTER (WHERE c = 'medium') AS medium, count(*) FILTER (WHERE c = 'low') AS low FROM c GROUP BY service")
def _(spark, sf):
    df = spans(spark, sf)
    stats = df.groupBy("service").agg(F.avg("duration_ms").alias("m"), F.stddev_pop("duration_ms").alias("s"))
    return K.severity_counts(df.join(F.broadcast(stats), "service"), K.impact_class((F.col("duration_ms") - F.col("m")) / F.col("s")), ["service"])


@query("cp31_cluster_input", f"WITH {SPANS} SELECT trace_id, span_id FROM spans WHERE start_ts >= TIMESTAMP '1995-01-01 00:00:00' AND start_ts <= TIMESTAMP '1997-01-01 00:00:00' AND error_type IS NOT NULL AND service LIKE 'svc-%' AND contains(lower(operation), 'op-1')")
def _(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return K.cluster_input(spans(spark, sf), at("1995-01-01 00:00:00"), at("1997-01-01 00:00:00"), "error_type", "svc-*", "OP-1").select("trace_id", "span_id")


@query("cp32_cluster_table", f"WITH {SPANS}, c AS (SELECT CASE WHEN line > 0 THEN line % 3 END AS cluster, span_id, operation FROM spans), p AS (SELECT cluster, operation, count(*) AS n FROM c GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, operation) AS k FROM p), e AS (SELECT cluster, span_id, row_number() OVER (PARTITION BY cluster ORDER BY span_id) AS k FROM c), x AS (SELECT cluster, string_agg(span_id, ',' ORDER BY span_id) AS examples FROM e WHERE k <= 3 GROUP BY cluster), s AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS size FROM p GROUP BY cluster) SELECT s.cluster, size, round(size / CAST((SELECT count(*) FROM c) AS DOUBLE), 6) AS share, operation AS label, examples, s.cluster IS NULL AS is_outlier FROM s JOIN l ON l.cluster IS NOT DISTINCT FROM s.cluster AND l.k = 1 JOIN x ON x.cluster IS NOT DISTINCT FROM s.cluster")
def _(spark, sf):
    rows = spans(spark, sf).withColumn("cluster", F.when(F.col("line") > 0, F.col("line") % 3))
    return rounded(K.cluster_table(rows, "span_id", F.col("operation")).withColumn("examples", F.array_join("examples", ",")), "share", digits=6)
