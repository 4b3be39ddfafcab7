"""Predicates, joins, aggregations, windows, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import predicates as P
from tracelake.functions import stats as S
from tracelake.functions.timeutil import bucket
from tracelake.operators import aggregate as A
from tracelake.operators import context as C
from tracelake.plans.fixtures import LOGS, METRICS, SPANS, logs, metrics, spans, table
from tracelake.plans.registry import query


def r(c, digits=4):
    return F.round(c, digits)


@query("p1_p4_filters", f"WITH {SPANS} SELECT service, count(*) AS n FROM spans WHERE service IN ('svc-1','svc-2','gateway') AND duration_ms >= 100 AND duration_ms < 2000 AND error_type IS NULL GROUP BY service")
def _(spark, sf):
    df = spans(spark, sf).filter(P.terms(F.col("service"), ["svc-1", "svc-2", "gateway"]) & P.between(F.col("duration_ms"), gte=100, lt=2000) & P.missing(F.col("error_type")))
    return df.groupBy("service").agg(F.count("*").alias("n"))


@query("p5_wildcard", f"WITH {SPANS} SELECT operation, count(*) AS n FROM spans WHERE regexp_matches(operation, '^op-1.*$') GROUP BY operation")
def _(spark, sf):
    return spans(spark, sf).filter(P.wildcard(F.col("operation"), "op-1*")).groupBy("operation").agg(F.count("*").alias("n"))


@query("p6_p7_text_match", f"WITH {LOGS} SELECT event_id, message FROM logs WHERE contains(lower(concat_ws(' ', message, service)), 'failed') AND contains(lower(concat_ws(' ', message, service)), 'svc-3')")
def _(spark, sf):
    return logs(spark, sf).filter(P.contains_all([F.col("message"), F.col("service")], "failed svc-3")).select("event_id", "message")


@query("p6_match_fuzzy", f"WITH {LOGS} SELECT level, count(*) AS n FROM logs WHERE contains(message, ' failed ') GROUP BY level")
def _(spark, sf):
    return logs(spark, sf).filter(P.match(F.col("message"), "faild", fuzzy=True)).groupBy("level").agg(F.count("*").alias("n"))


@query("p8_bool", f"WITH {LOGS} SELECT event_id FROM logs WHERE level <> 'info' AND (CAST(value > 250 AS INT) + CAST(service = 'svc-1' AS INT) + CAST(user_id < 50 AS INT)) >= 2 AND NOT (service = 'svc-2')")
def _(spark, sf):
    test = P.bool_([F.col("level") != "info"], [F.col("value") > 250, F.col("service") == "svc-1", F.col("user_id") < 50], [F.col("service") == "svc-2"], 2)
    return logs(spark, sf).filter(test).select("event_id")


@query("p9_p13_search_logs", f"WITH {LOGS} SELECT event_id, ts, level FROM logs WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND contains(service, 'svc-5') AND level IN ('error','fatal','critical')")
def _(spark, sf):
    df = P.search_logs(logs(spark, sf), start="2024-01-05 00:00:00", end="2024-01-20 00:00:00", service="SVC-5", errors_only=True)
    return df.select("event_id", "ts", "level")


@query("p10_service_filter", f"WITH {SPANS} SELECT service, count(*) AS n FROM spans WHERE lower(service) LIKE 'svc-%' GROUP BY service")
def _(spark, sf):
    return spans(spark, sf).filter(P.service_filter(F.col("service"), "SVC-*")).groupBy("service").agg(F.count("*").alias("n"))


@query("p11_p12_runtime_field", f"WITH {SPANS} SELECT span_id, CASE WHEN duration_ms > 1000 THEN 'slow' ELSE 'fast' END AS speed FROM spans WHERE service = 'gateway'")
def _(spark, sf):
    return spans(spark, sf).filter(F.col("service") == "gateway").select("span_id", F.when(F.col("duration_ms") > 1000, "slow").otherwise("fast").alias("speed"))


@query("p14_highlight", f"WITH {LOGS} SELECT event_id, regexp_replace(message, '(failed|error)', '<mark>\\1</mark>', 'g') AS marked FROM logs WHERE level = 'error'")
def _(spark, sf):
    return logs(spark, sf).filter("level = 'error'").select("event_id", P.highlight(F.col("message"), ["failed", "error"]).alias("marked"))


_CONTEXT = f"""WITH {LOGS}, hits AS (SELECT * FROM logs WHERE level = 'error'),
near AS (SELECT h.event_id AS hit, l.event_id AS near, CASE WHEN l.ts < h.ts THEN 'before' ELSE 'after' END AS side,
  row_number() OVER (PARTITION BY h.event_id, l.ts < h.ts ORDER BY abs(epoch_us(l.ts) - epoch_us(h.ts)), l.event_id) AS k
  FROM hits h JOIN logs l ON h.service = l.service AND l.event_id <> h.event_id AND abs(epoch_us(l.ts) - epoch_us(h.ts)) <= 3600000000)
SELECT hit, near, side FROM near WHERE k <= 3"""


@query("p15_j10_log_context", _CONTEXT)
def _(spark, sf):
    rows = logs(spark, sf)
    return C.log_context(rows.filter("level = 'error'"), rows, "event_id", k=3, window_s=3600)


_PLACE = "CAST(concat('0x', substr(md5(concat(event_id, '|0')), 1, 8)) AS BIGINT) % 10000"


@query("p16_severity_sample", f"WITH {LOGS} SELECT level, count(*) AS n FROM logs WHERE {_PLACE} < CASE level WHEN 'error' THEN 10000 WHEN 'warn' THEN 5000 ELSE 100 END GROUP BY level")
def _(spark, sf):
    return A.severity_sample(logs(spark, sf), "level", F.col("event_id"), {"error": 1.0, "warn": 0.5}, 0.01).groupBy("level").agg(F.count("*").alias("n"))


@query("p17_stratified_sample", f"WITH {LOGS}, t AS (SELECT count(*) AS n FROM logs), g AS (SELECT level, count(*) AS c FROM logs GROUP BY level) SELECT level, CAST(greatest(1, ceil(c * (least(ceil(t.n * 10 / 100.0), 1000) / t.n))) AS BIGINT) AS n FROM g, t")
def _(spark, sf):
    return A.stratified_sample(logs(spark, sf), "level", 10, 1000, F.col("event_id")).groupBy("level").agg(F.count("*").alias("n"))


@query("p18_s6_sampled_counts", f"WITH {LOGS} SELECT service, count(*) AS sampled, CAST(round(count(*) * 100 / 20.0) AS BIGINT) AS estimate FROM logs WHERE {_PLACE} < 2000 GROUP BY service")
def _(spark, sf):
    return A.sampled_counts(logs(spark, sf), "service", 20, F.col("event_id"))


@query("j3_compare_periods", f"""WITH {SPANS}, c AS (SELECT service, operation, count(*) AS n FROM spans WHERE line % 2 = 0 GROUP BY ALL), b AS (SELECT service, operation, count(*) AS n FROM spans WHERE line % 2 = 1 GROUP BY ALL)
SELECT service, operation, c.n AS current_n, b.n AS baseline_n, CASE WHEN b.n IS NULL THEN 'new' WHEN c.n IS NULL THEN 'removed' ELSE 'both' END AS state FROM c FULL OUTER JOIN b USING (service, operation)""")
def _(spark, sf):
    per = lambda k: spans(spark, sf).filter(F.col("line") % 2 == k).groupBy("service", "operation").agg(F.count("*").alias("n"))
    return A.compare_periods(per(0), per(1), ["service", "operation"], ["n"])


@query("j4_j5_anti", f"WITH {SPANS} SELECT DISTINCT operation FROM spans WHERE service = 'gateway' AND operation NOT IN (SELECT operation FROM spans WHERE service = 'svc-1')")
def _(spark, sf):
    df = spans(spark, sf)
    return df.filter("service = 'gateway'").select("operation").distinct().join(df.filter("service = 'svc-1'").select("operation"), "operation", "left_anti")


@query("j6_j7_align_series", f"""WITH {METRICS}, h AS (SELECT metric, time_bucket(INTERVAL '1 day', ts) AS bucket, avg(value) AS v FROM metrics GROUP BY ALL)
SELECT bucket, count(*) AS n, round(sum(v), 4) AS total FROM h GROUP BY bucket HAVING count(*) = (SELECT count(DISTINCT metric) FROM metrics)""")
def _(spark, sf):
    series = metrics(spark, sf).groupBy("metric", bucket(F.col("ts"), 86400).alias("bucket")).agg(F.avg("value").alias("v"))
    return C.align_series(series, "metric", "bucket").groupBy("bucket").agg(F.count("*").alias("n"), r(F.sum("v")).alias("total"))


@query("j8_correlate", f"""WITH {SPANS}, {LOGS}, {METRICS}
SELECT s.trace_id, count(l.event_id) AS logs FROM (SELECT DISTINCT trace_id FROM spans WHERE is_error) s JOIN logs l ON s.trace_id = l.trace_id GROUP BY s.trace_id""")
def _(spark, sf):
    hits = spans(spark, sf).filter("is_error").select("trace_id").distinct()
    return hits.join(logs(spark, sf), "trace_id").groupBy("trace_id").agg(F.count("event_id").alias("logs"))


@query("j9_nearest_bucket", f"""WITH {LOGS}, a AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS n FROM logs WHERE level = 'error' GROUP BY 1), b AS (SELECT time_bucket(INTERVAL '1 hour', ts) + INTERVAL '30 seconds' AS bucket, count(*) AS n FROM logs WHERE level = 'warn' GROUP BY 1)
SELECT a.bucket, a.n AS left_n, b.n AS right_n FROM a JOIN b ON abs(epoch_us(a.bucket) - epoch_us(b.bucket)) < 60000000""")
def _(spark, sf):
    rows = logs(spark, sf).withColumn("bucket", bucket(F.col("ts"), 3600))
    a = rows.filter("level = 'error'").groupBy("bucket").agg(F.count("*").alias("left_n"))
    b = rows.filter("level = 'warn'").groupBy((F.col("bucket") + F.expr("interval 30 seconds")).alias("other")).agg(F.count("*").alias("right_n"))
    return C.nearest(a, b, "bucket", "other", 60).select("bucket", "left_n", "right_n")


@query("j11_broadcast_lookup", f"WITH {SPANS} SELECT s.operation, CASE WHEN s.operation IN ('1-URGENT','2-HIGH') THEN 'hot' END AS heat, count(*) AS n FROM spans s WHERE service = 'gateway' GROUP BY ALL")
def _(spark, sf):
    heat = spark.createDataFrame([("1-URGENT", "hot"), ("2-HIGH", "hot")], "operation string, heat string")
    return spans(spark, sf).filter("service = 'gateway'").join(F.broadcast(heat), "operation", "left").groupBy("operation", "heat").agg(F.count("*").alias("n"))


@query("a1_a4_metrics", f"WITH {SPANS} SELECT service, count(duration_ms) AS count, min(duration_ms) AS min, max(duration_ms) AS max, round(avg(duration_ms), 4) AS avg, round(sum(duration_ms), 2) AS sum, round(stddev_pop(duration_ms), 4) AS std, round(var_pop(duration_ms), 2) AS variance, round(sum(duration_ms * duration_ms), 0) AS sum_of_squares FROM spans GROUP BY service")
def _(spark, sf):
    df = spans(spark, sf).groupBy("service").agg(*S.extended_stats("duration_ms"))
    return df.withColumns({"avg": r("avg"), "sum": r("sum", 2), "std": r("std"), "variance": r("variance", 2), "sum_of_squares": r("sum_of_squares", 0)})


@query("a5_cardinality", f"WITH {SPANS} SELECT service, count(DISTINCT trace_id) AS traces FROM spans GROUP BY service")
def _(spark, sf):
    return spans(spark, sf).groupBy("service").agg(F.count_distinct("trace_id").alias("traces"))


@query("a6_percentiles", f"WITH {SPANS} SELECT service, " + ", ".join(f"round(quantile_cont(duration_ms, {p}), 4) AS p{n}" for n, p in (("50", 0.5), ("75", 0.75), ("90", 0.9), ("95", 0.95), ("99", 0.99), ("99_9", 0.999))) + " FROM spans GROUP BY service")
def _(spark, sf):
    points = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}
    df = S.interpolated_percentiles(spans(spark, sf), ["service"], "duration_ms", points)
    return df.withColumns({k: r(k) for k in points})


@query("a6_rank_percentiles", f"WITH {SPANS} SELECT service, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, list_sort(list(duration_ms))[least(CAST(floor(0.99 * count(*)) AS BIGINT) + 1, count(*))] AS f99 FROM spans GROUP BY service")
def _(spark, sf):
    counts = S.value_counts(spans(spark, sf), ["service"], "duration_ms")
    near = S.rank_percentiles(counts, ["service"], "duration_ms", {"p50": 0.5, "p95": 0.95}, counted=True)
    return near.join(S.rank_percentiles(counts, ["service"], "duration_ms", {"f99": 0.99}, "floor", counted=True), "service")


@query("a7_a8_terms", f"WITH {SPANS} SELECT service, operation, count(*) AS count FROM spans GROUP BY ALL ORDER BY count DESC, service, operation LIMIT 20")
def _(spark, sf):
    return spans(spark, sf).groupBy("service", "operation").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "service", "operation").limit(20)


@query("a8_rollup", f"WITH {SPANS} SELECT service, operation, count(*) AS count, count(*) FILTER (WHERE is_error) AS errors FROM spans GROUP BY ROLLUP (service, operation)")
def _(spark, sf):
    return spans(spark, sf).rollup("service", "operation").agg(F.count("*").alias("count"), F.count_if("is_error").alias("errors"))


@query("a9_composite", f"WITH {SPANS} SELECT trace_id, service, count(*) AS count FROM spans GROUP BY ALL")
def _(spark, sf):
    return spans(spark, sf).groupBy("trace_id", "service").agg(F.count("*").alias("count"))


@query("a10_a15_date_histogram", f"WITH {LOGS} SELECT service, time_bucket(INTERVAL '6 hours', ts) AS bucket, count(*) AS count, count(*) FILTER (WHERE level = 'error') AS errors FROM logs GROUP BY ALL")
def _(spark, sf):
    return A.date_histogram(logs(spark, sf), "ts", 21600, ["service"], [F.count("*").alias("count"), F.count_if(F.col("level") == "error").alias("errors")])


@query("a11_empty_buckets", f"""WITH {LOGS}, b AS (SELECT service, time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS count FROM logs WHERE level = 'error' GROUP BY ALL),
e AS (SELECT service, unnest(generate_series(min(bucket), max(bucket), INTERVAL '1 hour')) AS bucket FROM b GROUP BY service)
SELECT e.service, e.bucket, coalesce(b.count, 0) AS count FROM e LEFT JOIN b USING (service, bucket)""")
def _(spark, sf):
    b = A.date_histogram(logs(spark, sf).filter("level = 'error'"), "ts", 3600, ["service"])
    return A.with_empty_buckets(b, ["service"], 3600, {"count": 0})


@query("a12_a19_calendar", f"WITH {LOGS} SELECT date_trunc('month', ts) AS month, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday, count(*) AS count FROM logs GROUP BY ALL")
def _(spark, sf):
    return logs(spark, sf).groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday")).agg(F.count("*").alias("count"))


@query("a14_histogram", f"WITH {METRICS} SELECT metric, CAST(floor(value / 25) * 25 AS DOUBLE) AS key, count(*) AS count FROM metrics GROUP BY ALL")
def _(spark, sf):
    return A.numeric_histogram(metrics(spark, sf), "value", 25.0, ["metric"])


@query("a16_a27_missing_and_sets", f"WITH {SPANS} SELECT service, count(*) FILTER (WHERE error_type IS NULL) AS missing, list_sort(list_distinct(list(error_type))) AS types FROM spans GROUP BY service")
def _(spark, sf):
    return spans(spark, sf).groupBy("service").agg(F.count_if(F.col("error_type").isNull()).alias("missing"), F.sort_array(F.collect_set("error_type")).alias("types"))


@query("a17_top_hit", f"WITH {SPANS} SELECT trace_id, arg_min(span_id, concat(strftime(start_ts, '%Y-%m-%d'), span_id)) AS first_span FROM spans GROUP BY trace_id")
def _(spark, sf):
    return spans(spark, sf).groupBy("trace_id").agg(F.min_by("span_id", F.struct("start_ts", "span_id")).alias("first_span"))


@query("a18_significant_terms", f"""WITH {SPANS}, g AS (SELECT operation, count(*) FILTER (WHERE is_error) AS fg, count(*) AS bg FROM spans GROUP BY operation), t AS (SELECT sum(fg) AS f, sum(bg) AS b FROM g)
SELECT operation, fg, bg, round((fg / f - bg / b) * ((fg / f) / (bg / b)), 6) AS score FROM g, t WHERE fg / f > bg / b ORDER BY score DESC, operation LIMIT 10""")
def _(spark, sf):
    return A.significant_terms(spans(spark, sf), "operation", F.col("is_error")).withColumn("score", r("score", 6))


@query("a20_sum_bucket", f"WITH {SPANS}, b AS (SELECT service, count(*) AS n, count(*) FILTER (WHERE is_error) AS e FROM spans GROUP BY service) SELECT CAST(sum(n) AS BIGINT) AS total, max(n) AS largest, round(avg(e / n), 6) AS mean_rate FROM b")
def _(spark, sf):
    b = spans(spark, sf).groupBy("service").agg(F.count("*").alias("n"), F.count_if("is_error").alias("e"))
    return b.agg(F.sum("n").alias("total"), F.max("n").alias("largest"), r(F.avg(F.col("e") / F.col("n")), 6).alias("mean_rate"))


@query("a21_rare", f"WITH {SPANS}, g AS (SELECT concat(service, operation) AS k, count(*) AS count FROM spans GROUP BY 1) SELECT k, count, round(count / (SELECT count(*) FROM spans), 6) AS share FROM g WHERE count >= 2 AND count < (SELECT count(*) FROM spans) * 0.008")
def _(spark, sf):
    return A.rare(spans(spark, sf).withColumn("k", F.concat("service", "operation")), "k", 0.008).withColumn("share", r("share", 6))


@query("a22_ranges", f"WITH {SPANS} SELECT CASE WHEN duration_ms < 100 THEN '<100' WHEN duration_ms < 500 THEN '100-500' ELSE '>=500' END AS range, count(*) AS count FROM spans GROUP BY 1")
def _(spark, sf):
    return spans(spark, sf).groupBy(F.when(F.col("duration_ms") < 100, "<100").when(F.col("duration_ms") < 500, "100-500").otherwise(">=500").alias("range")).agg(F.count("*").alias("count"))


@query("a23_pipeline_aggs", f"""WITH {METRICS}, d AS (SELECT metric, time_bucket(INTERVAL '1 day', ts) AS bucket, CAST(count(*) AS DOUBLE) AS v FROM metrics GROUP BY ALL)
SELECT metric, bucket, v, sum(v) OVER w AS cumulative_sum, v - lag(v) OVER w AS derivative, round(avg(v) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS moving_avg, v - lag(v, 7) OVER w AS serial_diff FROM d WINDOW w AS (PARTITION BY metric ORDER BY bucket)""")
def _(spark, sf):
    d = metrics(spark, sf).groupBy("metric", bucket(F.col("ts"), 86400).alias("bucket")).agg(F.count("*").cast("double").alias("v"))
    return A.cumulative(d, ["metric"], "bucket", "v", 7).withColumn("moving_avg", r("moving_avg"))


@query("a25_a26_log_stats", f"WITH {LOGS} SELECT service, count(*) AS n, count(*) FILTER (WHERE level = 'error') AS error, count(*) FILTER (WHERE level = 'warn') AS warn, count(*) FILTER (WHERE level = 'info') AS info, round(count(*) FILTER (WHERE level = 'error') * 1.0 / count(*), 6) AS error_rate, round(avg(length(message)), 4) AS mean_length FROM logs GROUP BY service")
def _(spark, sf):
    df = logs(spark, sf)
    levels = df.groupBy("service").pivot("level", ["error", "warn", "info"]).agg(F.count("message")).fillna(0)
    rest = df.groupBy("service").agg(F.count("*").alias("n"), r(F.avg((F.col("level") == "error").cast("int")), 6).alias("error_rate"), r(F.avg(F.length("message"))).alias("mean_length"))
    return rest.join(levels, "service")


@query("a28_weighted_mean", f"WITH {METRICS}, g AS (SELECT metric, service, avg(value) AS m, count(*) AS n FROM metrics GROUP BY ALL) SELECT metric, round(sum(m * n) / sum(n), 6) AS mean FROM g GROUP BY metric")
def _(spark, sf):
    g = metrics(spark, sf).groupBy("metric", "service").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return g.groupBy("metric").agg(r(S.weighted_mean(F.col("m"), F.col("n")), 6).alias("mean"))


_DAILY = f"WITH {METRICS}, d AS (SELECT metric, time_bucket(INTERVAL '1 day', ts) AS bucket, avg(value) AS v FROM metrics GROUP BY ALL)"


def daily(spark, sf):
    return metrics(spark, sf).groupBy("metric", bucket(F.col("ts"), 86400).alias("bucket")).agg(F.avg("value").alias("v"))


@query("w1_w5_frames", _DAILY + """ SELECT metric, bucket, round(avg(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS centred, round(avg(v) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS before_mean, round(stddev_pop(v) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS before_std, round(avg(v) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 4) AS after_mean, round(v / lag(v) OVER w, 6) AS ratio FROM d WINDOW w AS (PARTITION BY metric ORDER BY bucket)""")
def _(spark, sf):
    w = Window.partitionBy("metric").orderBy("bucket")
    return daily(spark, sf).select(
        "metric", "bucket", r(F.avg("v").over(w.rowsBetween(-2, 2))).alias("centred"), r(F.avg("v").over(w.rowsBetween(-5, -1))).alias("before_mean"),
        r(F.stddev_pop("v").over(w.rowsBetween(-5, -1))).alias("before_std"), r(F.avg("v").over(w.rowsBetween(0, 4))).alias("after_mean"), r(F.col("v") / F.lag("v").over(w), 6).alias("ratio"),
    )


@query("w7_islands", _DAILY + """, f AS (SELECT metric, bucket, v > avg(v) OVER (PARTITION BY metric) AS high, row_number() OVER (PARTITION BY metric ORDER BY bucket) AS r FROM d), g AS (SELECT *, r - row_number() OVER (PARTITION BY metric ORDER BY bucket) AS k FROM f WHERE high)
SELECT metric, min(bucket) AS first, max(bucket) AS last, count(*) AS length FROM g GROUP BY metric, k""")
def _(spark, sf):
    d = daily(spark, sf).withColumn("m", F.avg("v").over(Window.partitionBy("metric")))
    return A.islands(d, ["metric"], "bucket", F.col("v") > F.col("m"))


@query("w8_w9_extrema_halves", _DAILY + """, x AS (SELECT metric, v, lag(v) OVER w AS p, lead(v) OVER w AS n, row_number() OVER w AS i, count(*) OVER (PARTITION BY metric) AS c FROM d WINDOW w AS (PARTITION BY metric ORDER BY bucket))
SELECT metric, count(*) FILTER (WHERE (v > p AND v > n) OR (v < p AND v < n)) AS extrema, round(avg(v) FILTER (i <= floor(c / 2)), 4) AS first_half, round(avg(v) FILTER (i > floor(c / 2)), 4) AS second_half FROM x GROUP BY metric""")
def _(spark, sf):
    w = Window.partitionBy("metric").orderBy("bucket")
    x = daily(spark, sf).select("metric", "v", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("metric")).alias("c"))
    early = F.col("i") <= F.floor(F.col("c") / 2)
    peak = ((F.col("v") > F.col("p")) & (F.col("v") > F.col("n"))) | ((F.col("v") < F.col("p")) & (F.col("v") < F.col("n")))
    return x.groupBy("metric").agg(F.count_if(peak).alias("extrema"), r(F.avg(F.when(early, F.col("v")))).alias("first_half"), r(F.avg(F.when(~early, F.col("v")))).alias("second_half"))


@query("w10_w11_top_and_last", f"WITH {SPANS}, k AS (SELECT service, span_id, duration_ms, row_number() OVER (PARTITION BY service ORDER BY duration_ms DESC, span_id) AS rank FROM spans) SELECT service, span_id, duration_ms, rank FROM k WHERE rank <= 3")
def _(spark, sf):
    return A.top_per_group(spans(spark, sf).select("service", "span_id", "duration_ms"), ["service"], [F.desc("duration_ms"), F.asc("span_id")], 3)


@query("w12_inter_arrival", f"WITH {LOGS}, g AS (SELECT service, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY service ORDER BY ts, event_id) AS gap FROM logs) SELECT service, round(avg(gap) / 1000, 2) AS mean_ms, round(max(gap) / 1000, 2) AS max_ms FROM g GROUP BY service")
def _(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = logs(spark, sf).select("service", (us - F.lag(us).over(Window.partitionBy("service").orderBy("ts", "event_id"))).alias("gap"))
    return g.groupBy("service").agg(r(F.avg("gap") / 1000, 2).alias("mean_ms"), r(F.max("gap") / 1000, 2).alias("max_ms"))


@query("o1_o2_sort_page", f"WITH {SPANS} SELECT span_id, error_type FROM spans ORDER BY error_type ASC NULLS LAST, span_id LIMIT 50 OFFSET 25")
def _(spark, sf):
    return spans(spark, sf).select("span_id", "error_type").orderBy(F.asc_nulls_last("error_type"), "span_id").offset(25).limit(50)


@query("u1_u3_sets", f"WITH {SPANS} (SELECT operation FROM spans WHERE service = 'svc-1' INTERSECT SELECT operation FROM spans WHERE is_error) UNION (SELECT operation FROM spans WHERE service = 'gateway' EXCEPT SELECT operation FROM spans WHERE error_type = 'Memory')")
def _(spark, sf):
    df = spans(spark, sf)
    ops = lambda test: df.filter(test).select("operation")
    return ops("service = 'svc-1'").intersect(ops("is_error")).union(ops("service = 'gateway'").subtract(ops("error_type = 'Memory'"))).distinct()


@query("u2_first_by_priority", f"WITH {SPANS}, k AS (SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY is_error DESC, duration_ms DESC, span_id) AS r FROM spans) SELECT trace_id, span_id FROM k WHERE r = 1")
def _(spark, sf):
    return A.first_per_key(spans(spark, sf), ["trace_id"], [F.desc("is_error"), F.desc("duration_ms"), F.asc("span_id")]).select("trace_id", "span_id")


@query("s9_signal_availability", f"WITH {SPANS}, {LOGS}, {METRICS} SELECT 'logs' AS signal, count(*) AS n, min(ts) AS first, max(ts) AS last FROM logs UNION ALL SELECT 'metrics', count(*), min(ts), max(ts) FROM metrics UNION ALL SELECT 'spans', count(*), min(start_ts), max(start_ts) FROM spans")
def _(spark, sf):
    from tracelake.sources.io import signal_availability

    return signal_availability(spans(spark, sf), logs(spark, sf), metrics(spark, sf))


@query("s3_wide_to_long", "SELECT o_orderkey AS id, 'o_totalprice' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders")
def _(spark, sf):
    from tracelake.sources.io import wide_to_long

    wide = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return wide_to_long(wide, ["id"], ["o_totalprice", "o_custkey"])
