"""Streaming queries: the given events as a file stream, drained with ``availableNow``.

In append mode the last windows stay open, so the SQL has the closed ones only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import sketch
from tracelake.functions.stats import rank_percentiles
from tracelake.plans.fixtures import LOGS, SPANS, logs, spans, table
from tracelake.plans.registry import query
from tracelake.sources.io import stream_table
from tracelake.streaming import live as S


def events(spark, sf):
    schema = table(spark, sf, "events").schema
    df = stream_table(spark, f"{sf}/events.parquet*", schema, "ts", files_per_trigger=1)
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("info")
    return df.select("ts", level.alias("level"), F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("service"), "event_id", "value")


def ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("st3_tumbling", f"WITH {LOGS} SELECT time_bucket(INTERVAL '1 day', ts) AS start, service, count(*) AS count, round(avg(value), 6) AS avg FROM logs GROUP BY ALL")
def _(spark, sf):
    out = S.drain(S.tumbling(events(spark, sf), "1 day", ["service"]).drop("p", "end"), "update")
    last = out.groupBy("start", "service").agg(F.max_by(F.struct("count", "avg"), "_batch").alias("m"))
    return ntz(last.select("start", "service", "m.count", F.round("m.avg", 6).alias("avg")), "start")


@query("st4_sliding", f"WITH {LOGS}, o AS (SELECT unnest([0, 1]) AS k) SELECT time_bucket(INTERVAL '1 day', ts) - k * INTERVAL '1 day' AS start, count(*) AS count FROM logs, o GROUP BY 1")
def _(spark, sf):
    out = S.drain(S.sliding(events(spark, sf), "2 days", "1 day"), "complete")
    return ntz(out.groupBy("start").agg(F.max_by("count", "_batch").alias("count")), "start")


@query("st5_sessions", f"""WITH {LOGS}, g AS (SELECT service, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '1 hour' THEN 1 ELSE 0 END AS b FROM logs WINDOW w AS (PARTITION BY service ORDER BY ts)), s AS (SELECT service, ts, sum(b) OVER (PARTITION BY service ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), e AS (SELECT service, min(ts) AS start, count(*) AS count, max(ts) + INTERVAL '1 hour' AS finish FROM s GROUP BY service, k)
SELECT service, start, count FROM e WHERE finish <= (SELECT max(ts) FROM logs) - INTERVAL '10 minutes'""")
def _(spark, sf):
    return ntz(S.drain(S.sessions(events(spark, sf), ["service"], "1 hour")).select("service", "start", "count"), "start")


@query("st7_deduplicated", f"WITH {LOGS} SELECT service, count(*) AS n FROM logs GROUP BY service")
def _(spark, sf):
    twice = events(spark, sf).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return S.drain(S.without_duplicates(twice, ["event_id"])).groupBy("service").agg(F.count("*").alias("n"))


@query("st10_enriched", f"WITH {LOGS} SELECT CASE WHEN service IN ('svc-0', 'svc-1') THEN 'core' END AS team, count(*) AS n FROM logs GROUP BY 1")
def _(spark, sf):
    teams = spark.createDataFrame([("svc-0", "core"), ("svc-1", "core")], "service string, team string")
    return S.drain(S.enriched(events(spark, sf), teams)).groupBy("team").agg(F.count("*").alias("n"))


@query("st1_st2_drift", f"""WITH {LOGS}, w AS (SELECT service, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS count, avg(CAST(level = 'error' AS INT)) AS e FROM logs GROUP BY ALL), d AS (SELECT service, start, count, (count - lag(count) OVER v) / CAST(lag(count) OVER v AS DOUBLE) AS volume_drift, e - lag(e) OVER v AS error_drift FROM w WINDOW v AS (PARTITION BY service ORDER BY start))
SELECT service, start, count, round(volume_drift, 6) AS volume_drift, round(error_drift, 6) AS error_drift FROM d WHERE start + INTERVAL '1 day' <= (SELECT max(ts) FROM logs) - INTERVAL '10 minutes'""")
def _(spark, sf):
    d = S.drain(S.drift(events(spark, sf), 86400)).select("service", "start", "count", F.round("volume_drift", 6).alias("volume_drift"), F.round("error_drift", 6).alias("error_drift"))
    return ntz(d, "start")


def folder(spark, name):
    import uuid

    from tracelake.functions.lineage import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_BIN = "CASE WHEN value IS NULL THEN NULL WHEN abs(value) < 1e-9 THEN 0 ELSE CAST(sign(value) AS INT) * greatest(CAST(ceil(ln(abs(value) / 1e-9) / ln(1.01 / 0.99)) AS INT) + 1, 1) END"
_MIDDLE = "CASE WHEN {b} = 0 THEN 0.0 ELSE sign({b}) * exp((abs({b}) - 1) * ln(1.01 / 0.99)) * 1e-9 * 0.99 END"


@query("st3_live_percentiles", f"""WITH {LOGS}, b AS (SELECT time_bucket(INTERVAL '1 day', ts) AS start, service, {_BIN} AS bin, count(*) AS c FROM logs GROUP BY ALL HAVING bin IS NOT NULL), r AS (SELECT *, sum(c) OVER (PARTITION BY start, service ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY start, service) AS n FROM b),
q AS (SELECT start, service, CAST(max(n) AS BIGINT) AS count, min(bin) FILTER (WHERE upto >= greatest(ceil(0.5 * n), 1)) AS b50, min(bin) FILTER (WHERE upto >= greatest(ceil(0.95 * n), 1)) AS b95 FROM r GROUP BY start, service) SELECT start, service, count, round({_MIDDLE.format(b="b50")}, 6) AS p50, round({_MIDDLE.format(b="b95")}, 6) AS p95 FROM q""")
def _(spark, sf):
    out = S.drain(S.binned(events(spark, sf), "1 day", ["service"]), "update")
    last = out.groupBy("start", "service", "bin").agg(F.max_by("count", "_batch").alias("count"))
    q = sketch.quantiles(last, ["start", "service"], {"p50": 0.5, "p95": 0.95})
    return ntz(q.withColumns({c: F.round(c, 6) for c in ("p50", "p95")}), "start")


@query("st3_percentiles_within", f"""WITH {LOGS} SELECT service, count(value) AS count, true AS p50_within, true AS p95_within, true AS p99_within FROM logs GROUP BY service""")
def _(spark, sf):
    """Sketches of all windows merged by service, held against the exact percentiles of the rows."""
    out = S.drain(S.binned(events(spark, sf), "1 day", ["service"]), "update")
    last = out.groupBy("start", "service", "bin").agg(F.max_by("count", "_batch").alias("count"))
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    exact = rank_percentiles(logs(spark, sf), ["service"], "value", {f"x{k}": p for k, p in points.items()})
    both = sketch.quantiles(last, ["service"], points).join(exact, "service")
    return both.select("service", "count", *[(F.abs(F.col(k) - F.col(f"x{k}")) <= 0.0100001 * F.abs(F.col(f"x{k}"))).alias(f"{k}_within") for k in points])


def arriving(spark, sf, path):
    """The fixture's spans as files in the order of time: a span starts six hours after its trace's root for each line, a batch's files hold 180 days."""
    df = spans(spark, sf)
    roots = df.filter("parent_span_id is null").select("trace_id", F.col("start_ts").cast("timestamp").alias("began"))
    ts = F.col("began") + F.make_dt_interval(F.lit(0), F.col("line") * 6)
    df = df.join(roots, "trace_id").select("trace_id", "span_id", "parent_span_id", "service", ts.alias("ts"), "is_error", "duration_ms")
    files = S.in_order(df, F.floor(F.unix_date(F.to_date("ts")) / 180).cast("int"), path, 250_000)
    return stream_table(spark, path, df.schema, "ts", files_per_trigger=files)


#: A span and its parent lie this far apart at most.
APART = "3 days"


@query("st6_live_edges", f"WITH {SPANS} SELECT p.service AS source, c.service AS target, count(*) AS call_count, count(*) FILTER (WHERE c.is_error) AS error_count FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.service <> c.service GROUP BY ALL")
def _(spark, sf):
    edges = S.drained_edges(arriving(spark, sf, folder(spark, "spans")), "1 day", APART)
    return edges.groupBy("source", "target").agg(F.count("*").alias("call_count"), F.count_if("is_error").alias("error_count"))


#: Days by which the events of every fiftieth id arrive late. What is late is told by the watermark of the batch before.
_STEP = "CASE WHEN event_id % 50 = 0 THEN 3 ELSE 0 END"


@query("st9_late_rows", f"""WITH {LOGS}, a AS (SELECT event_id, service, ts, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + {_STEP} AS step FROM logs), m AS (SELECT step, max(max(ts)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL '1 day' AS mark FROM a GROUP BY step)
SELECT service, count(*) AS kept FROM a JOIN m USING (step) WHERE mark IS NULL OR ts > mark GROUP BY service UNION ALL SELECT 'dropped', count(*) FROM a JOIN m USING (step) WHERE ts <= mark""")
def _(spark, sf):
    """Events by service that a stream with a day's watermark keeps, and how many it reports as dropped."""
    path, progress = folder(spark, "events"), []
    df = logs(spark, sf).select("event_id", "service", F.col("ts").cast("timestamp").alias("ts"))
    S.in_order(df, (F.unix_date(F.to_date("ts")) + F.expr(_STEP)).cast("int"), path)
    kept = S.drain(S.without_duplicates(stream_table(spark, path, df.schema, "ts", files_per_trigger=1), ["event_id"], "1 day"), progress=progress)
    late = sum(S.late_rows(p) for p in progress)
    return kept.groupBy("service").agg(F.count("*").alias("kept")).unionByName(spark.createDataFrame([("dropped", late)], "service string, kept long"))


@query("st8_stream_clusters")
def _(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    static = table(spark, sf, "embeddings")
    features = array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    base = folder(spark, "clusters")
    KMeans(k=10, seed=7).fit(static.select(features)).save(f"{base}/model")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf}/embeddings.parquet*").select("vec_id", features)
    S.assign_clusters(stream, f"{base}/model", f"{base}/rows", f"{base}/state").start().awaitTermination()
    return spark.read.parquet(f"{base}/rows").select("vec_id", F.col("prediction").alias("cluster"))
