"""Queries of readers, sinks, automatic intervals, running means and baselines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tracelake.operators import aggregate as A
from tracelake.plans.fixtures import LOGS, SPANS, logs, spans
from tracelake.plans.q_streaming import folder
from tracelake.plans.registry import query
from tracelake.sources import io


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


def foreign_spans(spark, sf):
    """The fixture's spans under other names, with a status for errors, as files; their folder."""
    path = folder(spark, "foreign-spans")
    status = F.when(F.col("is_error"), "2").otherwise("1")
    df = spans(spark, sf).select(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.col("service").alias("service.name"), F.col("operation").alias("name"),
        F.col("start_ts").cast("timestamp").alias("startTime"), F.col("duration_ms").cast("double").alias("duration"), status.alias("status.code"), F.col("line").alias("line"),
    )
    io.write_table(df, path)
    return path


@query("s1_scan_spans", f"WITH {SPANS} SELECT trace_id, span_id, parent_span_id, service, operation, start_ts, duration_ms, is_error, CASE WHEN is_error THEN 'ERROR' ELSE 'OK' END AS status, CAST(line AS VARCHAR) AS line FROM spans WHERE start_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' ORDER BY spans.start_ts, spans.span_id LIMIT 500 OFFSET 100")
def _(spark, sf):
    rows = io.read_spans(spark, foreign_spans(spark, sf), start=datetime(1996, 1, 1), end=datetime(1996, 12, 31), size=500, offset=100, sort=["start_ts", "span_id"])
    kept = ("trace_id", "span_id", "parent_span_id", "service", "operation", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "duration_ms", "is_error", "status")
    return rows.select(*kept, F.col("attributes")["line"].alias("line"))


@query("s4_normalised_spans", f"WITH {SPANS} SELECT service, count(*) AS n, count(parent_span_id) AS children, count(*) FILTER (WHERE is_error) AS errors, round(sum(duration_ms), 2) AS ms FROM spans GROUP BY service")
def _(spark, sf):
    rows = io.read_spans(spark, foreign_spans(spark, sf))
    return rows.groupBy("service").agg(F.count("*").alias("n"), F.count("parent_span_id").alias("children"), F.count_if("is_error").alias("errors"), F.round(F.sum("duration_ms"), 2).alias("ms"))


@query("s2_scan_logs", f"WITH {LOGS} SELECT ts, level, message, service, trace_id FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-11 12:00:00' ORDER BY logs.ts DESC, logs.trace_id LIMIT 200")
def _(spark, sf):
    path = folder(spark, "foreign-logs")
    df = logs(spark, sf).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("@timestamp"), F.col("level").alias("SeverityText"), F.col("message").alias("Body"), F.col("service").alias("service.name"), F.col("trace_id").alias("traceId"))
    io.write_table(df, path, "json")
    rows = io.read_logs(spark, path, "json", start=datetime(2024, 1, 10), end=datetime(2024, 1, 11, 12), size=200, sort=[F.desc("ts"), "trace_id"])
    return rows.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "message", "service", "trace_id")


@query("s8_json_texts", f"WITH {LOGS} SELECT level, count(*) AS n, count(DISTINCT event_id) AS ids, round(sum(value), 4) AS value FROM logs GROUP BY level")
def _(spark, sf):
    """Rows written as JSON texts and read again."""
    path, df = folder(spark, "texts"), logs(spark, sf).select("event_id", "level", "message", "value")
    io.write_table(io.as_json(df).withColumnRenamed("json", "value"), path, "text")
    back = spark.read.schema(df.schema).json(path)
    return back.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("value"))


_WIDTHS = (1, 5, 10, 30, 60, 300, 600, 1800, 3600, 10800, 21600, 43200, 86400, 604800, 2592000)


@query("a13_auto_histogram", f"WITH {LOGS}, r AS (SELECT epoch(max(ts)) - epoch(min(ts)) AS s FROM logs), w AS (SELECT min(w) AS w FROM (SELECT unnest({list(_WIDTHS)}) AS w), r WHERE s / w <= 49) SELECT w AS interval, make_timestamp(CAST(floor(epoch(ts) / w) * w * 1000000 AS BIGINT)) AS bucket, count(*) AS count FROM logs, w GROUP BY ALL")
def _(spark, sf):
    return A.auto_date_histogram(logs(spark, sf), "ts", 50).select("interval", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "count")


@query("a24_running_means", f"WITH {SPANS}, b AS (SELECT service, time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS bucket, CAST(sum(duration_ms) AS DOUBLE) AS total, count(*) AS n FROM spans GROUP BY ALL) SELECT service, bucket, n, round(sum(total) OVER w / sum(n) OVER w, 4) AS mean FROM b WINDOW w AS (PARTITION BY service ORDER BY bucket)")
def _(spark, sf):
    per = A.date_histogram(spans(spark, sf), "start_ts", 30 * 86400, ["service"], [F.sum("duration_ms").cast("double").alias("total"), F.count("*").alias("n")])
    return rounded(A.running_mean(per, ["service"], "bucket", "total", "n").select("service", "bucket", "n", "mean"), "mean")


@query("cp24_baseline_stats", f"WITH {SPANS}, p AS (SELECT service, time_bucket(INTERVAL '30 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS b, CAST(count(*) AS DOUBLE) AS requests, CAST(avg(duration_ms) AS DOUBLE) AS avg_ms FROM spans GROUP BY ALL), l AS (SELECT service, unnest(['requests', 'avg_ms']) AS measure, unnest([requests, avg_ms]) AS value FROM p) SELECT service, measure, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, count(value) AS periods FROM l GROUP BY ALL")
def _(spark, sf):
    per = A.date_histogram(spans(spark, sf), "start_ts", 30 * 86400, ["service"], [F.count("*").alias("requests"), F.avg("duration_ms").alias("avg_ms")])
    return rounded(A.baseline_stats(per, ["service"], ["requests", "avg_ms"]), "mean", "std", "min", "max")
