"""Span, trace and span-tree queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import predicates as P
from tracelake.operators import spans as N
from tracelake.operators import trees as T
from tracelake.plans.fixtures import LOGS, SPANS, logs, spans
from tracelake.plans.registry import query

def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("n1_span_stats", f"WITH {SPANS} SELECT count(*) AS count, round(avg(duration_ms), 4) AS avg, min(duration_ms) AS min, max(duration_ms) AS max, round(avg(CAST(is_error AS INT)), 6) AS error_rate, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99 FROM spans")
def _(spark, sf):
    return rounded(rounded(N.span_stats(spans(spark, sf)), "avg"), "error_rate", digits=6)


@query("n3_operation_performance", f"WITH {SPANS} SELECT service, operation, count(*) AS count, round(avg(duration_ms), 4) AS avg, min(duration_ms) AS min, max(duration_ms) AS max, round(avg(CAST(is_error AS INT)), 6) AS error_rate, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99 FROM spans GROUP BY ALL")
def _(spark, sf):
    return rounded(rounded(N.span_stats(spans(spark, sf), ["service", "operation"]), "avg"), "error_rate", digits=6)


@query("n2_bottlenecks", f"""WITH {SPANS}, c AS (SELECT quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99 FROM spans),
x AS (SELECT span_id, greatest(CASE WHEN duration_ms > p99 THEN 0.9 ELSE 0.0 END, CASE WHEN duration_ms > p95 AND duration_ms <= p99 THEN 0.7 ELSE 0.0 END, CASE WHEN is_error THEN 0.8 ELSE 0.0 END) AS impact,
concat_ws(', ', CASE WHEN duration_ms > p99 THEN 'above p99' END, CASE WHEN duration_ms > p95 AND duration_ms <= p99 THEN 'above p95' END, CASE WHEN is_error THEN 'error' END) AS reasons FROM spans, c)
SELECT span_id, CAST(impact AS DOUBLE) AS impact, reasons FROM x WHERE impact > 0""")
def _(spark, sf):
    return N.span_bottlenecks(spans(spark, sf)).select("span_id", "impact", "reasons")


@query("n4_compare_ranges", f"""WITH {SPANS}, s AS (SELECT start_ts < TIMESTAMP '1995-07-01 00:00:00' AS early, service, count(*) AS n, avg(duration_ms) AS a, quantile_disc(duration_ms, 0.95) AS p95 FROM spans GROUP BY ALL)
SELECT c.service, round((c.n - b.n) / CAST(b.n AS DOUBLE), 6) AS count_change, round((c.a - b.a) / b.a, 6) AS avg_change, round((c.p95 - b.p95) / b.p95, 6) AS p95_change,
CASE WHEN (c.a - b.a) / b.a > 0.1 THEN 'degraded' WHEN (c.a - b.a) / b.a < -0.1 THEN 'improved' ELSE 'stable' END AS state FROM s c JOIN s b ON c.service = b.service AND NOT c.early AND b.early""")
def _(spark, sf):
    df, cut = spans(spark, sf), "1995-07-01 00:00:00"
    out = N.compare_spans(df.filter(F.col("start_ts") >= F.lit(cut).cast("timestamp_ntz")), df.filter(F.col("start_ts") < F.lit(cut).cast("timestamp_ntz")), ["service"])
    return rounded(out.select("service", "count_change", "avg_change", "p95_change", "state"), "count_change", "avg_change", "p95_change", digits=6)


@query("n5_common_attributes", f"""WITH {SPANS}, p AS (SELECT 'operation' AS key, operation AS value FROM spans UNION ALL SELECT 'service', service FROM spans), c AS (SELECT key, value, count(*) AS count FROM p GROUP BY ALL),
k AS (SELECT *, CAST(sum(count) OVER (PARTITION BY key) AS BIGINT) AS key_count, row_number() OVER (PARTITION BY key ORDER BY count DESC, value) AS rank FROM c) SELECT * FROM k WHERE rank <= 10""")
def _(spark, sf):
    df = spans(spark, sf).withColumn("attributes", F.create_map(F.lit("operation"), "operation", F.lit("service"), "service"))
    return N.common_attributes(df)


@query("n6_attribute_patterns", f"WITH {SPANS} SELECT CASE WHEN error_type IS NULL THEN 'service' ELSE 'error,service' END AS pattern, count(*) AS count, round(avg(duration_ms), 4) AS avg, min(span_id) AS example FROM spans GROUP BY 1")
def _(spark, sf):
    df = spans(spark, sf).withColumn("attributes", F.map_filter(F.create_map(F.lit("service"), "service", F.lit("error"), "error_type"), lambda k, v: v.isNotNull()))
    return rounded(N.attribute_patterns(df), "avg")


@query("n7_attribute_correlation", f"WITH {SPANS} SELECT round(corr(CAST(line AS DOUBLE), duration_ms), 6) AS corr FROM spans")
def _(spark, sf):
    return rounded(N.attribute_correlation(spans(spark, sf), F.col("line"), F.col("duration_ms")), "corr", digits=6)


@query("n8_event_types", f"WITH {SPANS} SELECT CASE WHEN is_error THEN 'exception' ELSE 'done' END AS event, count(*) AS count, 5000.0 AS latency_ms, count(DISTINCT service) AS services, CASE WHEN is_error THEN true ELSE false END AS is_error FROM spans GROUP BY ALL")
def _(spark, sf):
    event = F.struct(F.when(F.col("is_error"), "exception").otherwise("done").alias("name"), (F.col("start_ts") + F.expr("interval 5 seconds")).alias("ts"))
    return N.event_types(spans(spark, sf).withColumn("events", F.array(event)))


@query("n8_event_sequences", f"WITH {SPANS} SELECT CASE WHEN is_error THEN 'start > exception' ELSE 'start > done' END AS sequence, count(*) AS count FROM spans GROUP BY 1")
def _(spark, sf):
    last = F.struct((F.col("start_ts") + F.expr("interval 5 seconds")).alias("ts"), F.when(F.col("is_error"), "exception").otherwise("done").alias("name"))
    return N.event_sequences(spans(spark, sf).withColumn("events", F.array(last, F.struct(F.col("start_ts").alias("ts"), F.lit("start").alias("name")))))


@query("n9_trace_overview", f"WITH {SPANS} SELECT count(*) AS spans, count(DISTINCT trace_id) AS traces, count(DISTINCT CASE WHEN is_error THEN trace_id END) AS error_traces, round(avg(duration_ms), 4) AS avg, min(duration_ms) AS min, max(duration_ms) AS max, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95, round(quantile_cont(duration_ms, 0.99), 4) AS p99, round(count(DISTINCT CASE WHEN is_error THEN trace_id END) * 100.0 / count(DISTINCT trace_id), 4) AS error_percent FROM spans")
def _(spark, sf):
    return rounded(N.trace_overview(spans(spark, sf)), "avg", "p50", "p95", "p99", "error_percent")


_TRACES = f"""WITH {SPANS}, t AS (SELECT trace_id, min(start_ts) AS start_ts, (max(epoch_us(start_ts) + CAST(trunc(duration_ms * 1000) AS BIGINT)) - min(epoch_us(start_ts))) / 1000.0 AS duration_ms, count(*) AS span_count, count(*) FILTER (WHERE is_error) AS error_count, count(DISTINCT service) AS services, sum(duration_ms) AS total_ms FROM spans GROUP BY trace_id)"""


@query("g16_g18_trace_table", _TRACES + " SELECT trace_id, start_ts, span_count, error_count, services, CAST(round(total_ms, 0) AS BIGINT) AS total_ms FROM t")
def _(spark, sf):
    return N.trace_table(spans(spark, sf)).select("trace_id", "start_ts", "span_count", "error_count", "services", F.round("total_ms", 0).cast("long").alias("total_ms"))


@query("g18_trace_stats", _TRACES + " SELECT count(*) AS traces, round(avg(duration_ms), 2) AS avg, round(min(duration_ms), 2) AS min, round(max(duration_ms), 2) AS max, round(avg(CAST(error_count > 0 AS INT)), 6) AS error_share, round(avg(span_count), 4) AS mean_spans FROM t")
def _(spark, sf):
    return rounded(rounded(rounded(N.trace_stats(spans(spark, sf)), "avg", "min", "max", digits=2), "error_share", digits=6), "mean_spans")


@query("g19_trace_patterns", f"""WITH {SPANS}, t AS (SELECT trace_id, array_to_string(list_sort(list(concat_ws(':', service, operation))), '|') AS pattern, sum(duration_ms) AS total, max(is_error) AS e FROM spans GROUP BY trace_id)
SELECT pattern, count(*) AS count, round(avg(total), 0) AS avg, round(avg(CAST(e AS INT)), 6) AS error_rate, min(trace_id) AS example FROM t GROUP BY pattern""")
def _(spark, sf):
    return rounded(rounded(N.trace_patterns(spans(spark, sf)), "avg", digits=0), "error_rate", digits=6)


@query("g17_timeline", f"WITH {SPANS} SELECT trace_id, span_id, round((epoch_us(start_ts) - min(epoch_us(start_ts)) OVER (PARTITION BY trace_id)) / 1000.0, 2) AS offset_ms, CASE WHEN is_error THEN 'ERROR' ELSE 'OK' END AS status FROM spans")
def _(spark, sf):
    return rounded(N.timeline(spans(spark, sf)).select("trace_id", "span_id", "offset_ms", "status"), "offset_ms", digits=2)


@query("g20_traces_per_window", f"WITH {SPANS} SELECT time_bucket(INTERVAL '7 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS bucket, count(DISTINCT trace_id) AS traces FROM spans GROUP BY 1")
def _(spark, sf):
    return spans(spark, sf).groupBy(F.window("start_ts", "7 days")["start"].alias("bucket")).agg(F.count_distinct("trace_id").alias("traces"))


@query("g15_slow_traces", f"WITH {SPANS}, t AS (SELECT trace_id, sum(duration_ms) AS total_ms FROM spans GROUP BY trace_id) SELECT trace_id, round(total_ms, 2) AS total_ms FROM t WHERE total_ms >= 0.9 * (SELECT quantile_cont(total_ms, 0.95) FROM t)")
def _(spark, sf):
    return rounded(N.slow_traces(spans(spark, sf)), "total_ms", digits=2)


@query("g21_cp17_lookup", f"WITH {SPANS} SELECT * FROM spans WHERE trace_id IN ('1', '7', '100')")
def _(spark, sf):
    return spans(spark, sf).filter(P.terms(F.col("trace_id"), ["1", "7", "100"]))


@query("l1_u4_services", f"WITH {SPANS}, {LOGS}, a AS (SELECT service, count(*) AS spans FROM spans GROUP BY service), b AS (SELECT service, count(*) AS logs FROM logs GROUP BY service) SELECT service, coalesce(spans, 0) AS spans, coalesce(logs, 0) AS logs FROM a FULL OUTER JOIN b USING (service)")
def _(spark, sf):
    return N.list_services(spans(spark, sf), logs(spark, sf)).select("service", "spans", "logs")


@query("cp16_error_traces", f"WITH {SPANS} SELECT trace_id, count(*) AS errors, min(start_ts) AS first_error, list_sort(list_distinct(list(error_type))) AS types FROM spans WHERE is_error GROUP BY trace_id")
def _(spark, sf):
    return N.error_traces(spans(spark, sf))


@query("cp33_trace_search", f"WITH {SPANS} SELECT span_id FROM spans WHERE contains(lower(concat_ws(' ', operation, service)), 'svc-3') AND contains(lower(concat_ws(' ', operation, service)), 'op-1') ORDER BY start_ts DESC, span_id LIMIT 100")
def _(spark, sf):
    return P.search_traces(spans(spark, sf), "svc-3 op-1", 100).select("span_id")


_PATHS = f"""WITH RECURSIVE {SPANS},
rooted AS (SELECT s.*, s.parent_span_id IS NULL OR s.parent_span_id = s.span_id OR p.span_id IS NULL AS is_root FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id),
paths AS (SELECT trace_id, span_id, [span_id] AS path, [service] AS services, [operation] AS operations, [duration_ms] AS durations, duration_ms AS total FROM rooted WHERE is_root
UNION ALL SELECT c.trace_id, c.span_id, list_append(p.path, c.span_id), list_append(p.services, c.service), list_append(p.operations, c.operation), list_append(p.durations, c.duration_ms), p.total + c.duration_ms FROM paths p JOIN rooted c ON NOT c.is_root AND c.trace_id = p.trace_id AND c.parent_span_id = p.span_id),
ends AS (SELECT * FROM paths WHERE NOT EXISTS (SELECT 1 FROM spans c WHERE c.trace_id = paths.trace_id AND c.parent_span_id = paths.span_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY total DESC, path) AS k FROM ends)"""


@query("g7_trace_paths", _PATHS + " SELECT trace_id, array_to_string(services, ' -> ') AS path, CAST(len(path) AS INT) AS depth, round(total, 4) AS total FROM ends")
def _(spark, sf):
    df = spans(spark, sf)
    ends = T.leaves(T.span_paths(df), df)
    return ends.select("trace_id", F.array_join("services", " -> ").alias("path"), "depth", F.round(F.aggregate("durations", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("g9_critical_path", _PATHS + " SELECT trace_id, array_to_string(path, ',') AS path, round(total, 4) AS total FROM best WHERE k = 1")
def _(spark, sf):
    return T.critical_paths(spans(spark, sf)).select("trace_id", F.array_join("path", ",").alias("path"), F.round("total", 4).alias("total"))


@query("g10_critical_path_min", _PATHS + " SELECT trace_id, array_to_string(list_filter(path, lambda x, i: durations[i] >= 200), ',') AS path FROM best WHERE k = 1")
def _(spark, sf):
    return T.critical_paths(spans(spark, sf), min_duration=200.0).select("trace_id", F.array_join("path", ",").alias("path"))


_STATS = _PATHS + """, st AS (SELECT trace_id, services, operations, durations, total AS total_ms, list_sum(list_transform(durations, lambda x, i: greatest(0.0, x - coalesce(durations[i + 1], 0.0)))) AS self_ms, len(path) AS length, array_to_string(list_transform(services, lambda x, i: concat_ws(':', x, operations[i])), ' -> ') AS pattern FROM best WHERE k = 1)"""


@query("g11_path_stats", _STATS + " SELECT trace_id, round(total_ms, 4) AS total_ms, round(self_ms, 4) AS self_ms, CAST(length AS INT) AS length, pattern FROM st")
def _(spark, sf):
    s = T.path_stats(T.critical_paths(spans(spark, sf)))
    return rounded(s.select("trace_id", "total_ms", "self_ms", "length", "pattern"), "total_ms", "self_ms")


@query("g12_path_summary", _STATS + ", c AS (SELECT pattern, count(*) AS c FROM st GROUP BY pattern) SELECT round(avg(total_ms), 4) AS avg, round(avg(length), 4) AS mean_length, round(quantile_disc(total_ms, 0.5), 2) AS p50, round(quantile_disc(total_ms, 0.95), 2) AS p95, (SELECT pattern FROM c ORDER BY c DESC, pattern DESC LIMIT 1) AS pattern FROM st")
def _(spark, sf):
    s = T.path_summary(T.path_stats(T.critical_paths(spans(spark, sf))))
    return rounded(rounded(s.select("avg", "mean_length", "p50", "p95", "pattern"), "avg", "mean_length"), "p50", "p95", digits=2)


@query("g13_g14_path_bottlenecks", _STATS + """, x AS (SELECT unnest(services) AS service, unnest(durations) AS ms FROM st), b AS (SELECT service, avg(ms) AS avg, quantile_disc(ms, 0.95) AS p95, count(*) AS frequency, sum(ms) AS s FROM x GROUP BY service)
SELECT service, round(avg * 0.3, 4) AS saving_ms, CASE WHEN avg > 1000 THEN 3 WHEN avg > 500 THEN 2 ELSE 1 END AS effort, round(s * 100 / (SELECT sum(ms) FROM x) / CASE WHEN avg > 1000 THEN 3 WHEN avg > 500 THEN 2 ELSE 1 END, 4) AS roi FROM b ORDER BY (avg * 0.5 + p95 * 0.3) * ln(frequency + 1) DESC, service LIMIT 10""")
def _(spark, sf):
    b = T.path_bottlenecks(T.path_stats(T.critical_paths(spans(spark, sf))))
    return rounded(T.savings(b), "saving_ms", "roi")


_UP = f"""WITH RECURSIVE {SPANS}, e AS (SELECT * FROM spans WHERE is_error),
chain AS (SELECT trace_id, span_id AS origin, 0 AS depth, parent_span_id AS nxt, service, error_type FROM e
UNION ALL SELECT c.trace_id, c.origin, c.depth + 1, p.parent_span_id, p.service, p.error_type FROM chain c JOIN e p ON p.trace_id = c.trace_id AND p.span_id = c.nxt),
chains AS (SELECT trace_id, origin, list(service ORDER BY depth) AS services, count(*) AS length, count(DISTINCT error_type) > 1 AS transformed FROM chain GROUP BY ALL HAVING count(*) > 1),
kinds AS (SELECT *, CASE WHEN len(list_distinct(services)) < len(services) THEN 'circular' WHEN length > 3 THEN 'cascade' ELSE 'simple' END AS kind, array_to_string(services, ' -> ') AS pattern FROM chains)"""


def upstream(spark, sf):
    return T.classify_chains(T.error_chains(spans(spark, sf), "upstream"))


@query("g22_g23_error_chains", _UP + " SELECT trace_id, origin, pattern, CAST(length AS INT) AS length, kind, transformed FROM kinds")
def _(spark, sf):
    return upstream(spark, sf).select("trace_id", "origin", "pattern", "length", "kind", "transformed")


@query("g22_downstream_chains", f"""WITH RECURSIVE {SPANS}, e AS (SELECT * FROM spans WHERE is_error),
chain AS (SELECT trace_id, span_id AS origin, 0 AS depth, span_id AS node, service, start_ts FROM e UNION ALL SELECT c.trace_id, c.origin, c.depth + 1, p.span_id, p.service, p.start_ts FROM chain c JOIN e p ON p.trace_id = c.trace_id AND p.parent_span_id = c.node AND p.parent_span_id <> p.span_id)
SELECT trace_id, origin, array_to_string(list(service ORDER BY depth, start_ts, node), ' -> ') AS pattern, CAST(count(*) AS INT) AS length FROM chain GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    return T.classify_chains(T.error_chains(spans(spark, sf), "downstream")).select("trace_id", "origin", "pattern", "length")


@query("g24_consolidated_chains", _UP + " SELECT pattern, kind, count(*) AS occurrences, CAST(max(length) AS INT) AS depth, CAST(max(length) * 10 + len(list_distinct(any_value(services))) * 5 + least(count(*) * 2, 20) + CASE WHEN count(*) FILTER (WHERE transformed) > 0 THEN 10 ELSE 0 END AS BIGINT) AS severity FROM kinds GROUP BY pattern, kind")
def _(spark, sf):
    return T.cascade_severity(T.consolidate_chains(upstream(spark, sf))).select("pattern", "kind", "occurrences", "depth", F.col("severity").cast("long").alias("severity"))


@query("g25_error_sources", _UP + ", p AS (SELECT services[1] AS source, count(*) AS occurrences FROM kinds GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY occurrences DESC, source) AS rank FROM p) SELECT source, occurrences, round(occurrences * 100.0 / (SELECT sum(occurrences) FROM p), 4) AS share, CASE WHEN rank <= 3 THEN 'primary' ELSE 'secondary' END AS role FROM k WHERE rank <= 10")
def _(spark, sf):
    return rounded(T.error_sources(upstream(spark, sf)), "share")


@query("g26_error_impact", _UP + ", b AS (SELECT avg(length) AS amplification, CAST(max(length) AS INT) AS max_amplification, count(*) FILTER (WHERE kind = 'cascade') AS cascades FROM kinds), s AS (SELECT count(DISTINCT x) AS services FROM (SELECT unnest(services) AS x FROM kinds)) SELECT services, round(amplification, 4) AS amplification, max_amplification, cascades, CASE WHEN cascades > 10 THEN 'high' WHEN cascades > 5 THEN 'medium' ELSE 'low' END AS risk, round(least(100.0, services * 10 + amplification * 5 + cascades * 2), 4) AS score FROM b, s")
def _(spark, sf):
    return rounded(T.error_impact(upstream(spark, sf)), "amplification", "score")


@query("g27_j14_dependency_errors", f"WITH {SPANS} SELECT p.service AS parent, c.service AS child, count(*) AS errors, list_sort(list_distinct(list(c.error_type))) AS types FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE c.is_error AND p.is_error GROUP BY ALL")
def _(spark, sf):
    return T.dependency_errors(spans(spark, sf))
