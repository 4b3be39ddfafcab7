"""Span and trace statistics: overview, operations, bottlenecks, attributes, events, traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.stats import interpolated_percentiles, percent, rank_percentiles, ratio


def span_stats(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """count, avg/min/max, p50/95/99 by nearest rank and error rate, overall or per key."""
    base = spans.groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg("duration_ms").alias("avg"), F.min("duration_ms").alias("min"), F.max("duration_ms").alias("max"), ratio(F.count_if("is_error"), F.count("*")).alias("error_rate")
    )
    ranks = rank_percentiles(spans, keys, "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return base.join(ranks, list(keys), "left") if keys else base.crossJoin(F.broadcast(ranks))


def span_bottlenecks(spans: DataFrame, attributes: Column | None = None) -> DataFrame:
    """Spans above p95/p99, in error, or with over 50 attributes: highest impact and all reasons."""
    cut = F.broadcast(rank_percentiles(spans, [], "duration_ms", {"p95": 0.95, "p99": 0.99}))
    rows = spans.crossJoin(cut)
    many = (attributes if attributes is not None else F.lit(0)) > 50
    d = F.col("duration_ms")
    rules = [(d > F.col("p99"), 0.9, "above p99"), ((d > F.col("p95")) & (d <= F.col("p99")), 0.7, "above p95"), (F.col("is_error"), 0.8, "error"), (many, 0.5, "many attributes")]
    impact = F.greatest(*[F.when(test, v).otherwise(0.0) for test, v, _ in rules])
    reasons = F.concat_ws(", ", *[F.when(test, name) for test, _, name in rules])
    return rows.select("trace_id", "span_id", "service", "operation", "duration_ms", impact.alias("impact"), reasons.alias("reasons")).filter("impact > 0")


def compare_spans(current: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("service", "operation"), change: float = 0.1) -> DataFrame:
    """Relative change of avg, error rate, volume, p95 and p99; degraded or improved by the average."""
    a, b = span_stats(current, keys), span_stats(baseline, keys)
    values = ("count", "avg", "error_rate", "p95", "p99")
    joined = a.select(*keys, *(F.col(v).alias(f"c_{v}") for v in values)).join(b.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values)), list(keys))
    out = joined.select(*keys, *(ratio(F.col(f"c_{v}") - F.col(f"b_{v}"), F.col(f"b_{v}")).alias(f"{v}_change") for v in values))
    return out.withColumn("state", F.when(F.col("avg_change") > change, "degraded").when(F.col("avg_change") < -change, "improved").otherwise("stable"))


def common_attributes(df: DataFrame, attributes: str = "attributes", n: int = 10) -> DataFrame:
    """Per key its count and its n commonest values."""
    pairs = df.select(F.explode(attributes).alias("key", "value"))
    per = pairs.groupBy("key", "value").agg(F.count("*").alias("count"))
    w = Window.partitionBy("key")
    ranked = per.withColumn("key_count", F.sum("count").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("count"), "value")).cast("long"))
    return ranked.filter(F.col("rank") <= n)


def attribute_patterns(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Sorted key sets: count, mean duration, first examples."""
    key = F.array_join(F.array_sort(F.map_keys(attributes)), ",").alias("pattern")
    return df.groupBy(key).agg(F.count("*").alias("count"), F.avg("duration_ms").alias("avg"), F.min("span_id").alias("example"))


def attribute_correlation(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.corr(a.cast("double"), b.cast("double")).alias("corr"))


def event_types(df: DataFrame, events: str = "events") -> DataFrame:
    """Event names: count, mean latency from the span's start, services, and whether they speak of errors."""
    e = df.select("service", "start_ts", F.explode(events).alias("e"))
    latency = (F.unix_micros(F.col("e.ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1000.0
    out = e.groupBy(F.col("e.name").alias("event")).agg(F.count("*").alias("count"), F.avg(latency).alias("latency_ms"), F.count_distinct("service").alias("services"))
    return out.withColumn("is_error", F.lower("event").rlike("error|exception|fail"))


def event_sequences(df: DataFrame, events: str = "events") -> DataFrame:
    ordered = F.transform(F.array_sort(F.transform(events, lambda e: F.struct(e["ts"].alias("ts"), e["name"].alias("name")))), lambda e: e["name"])
    return df.filter(F.size(events) > 0).groupBy(F.array_join(ordered, " > ").alias("sequence")).agg(F.count("*").alias("count"))


def trace_overview(spans: DataFrame) -> DataFrame:
    """Distinct traces and error traces, error share in %, duration statistics."""
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    out = spans.agg(
        F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces"), F.count_distinct(F.when(F.col("is_error"), F.col("trace_id"))).alias("error_traces"),
        F.avg("duration_ms").alias("avg"), F.min("duration_ms").alias("min"), F.max("duration_ms").alias("max"),
    )
    middle = interpolated_percentiles(spans, [], "duration_ms", points)
    out = out.join(F.broadcast(middle), how="left")  # a row each
    out = out.select("spans", "traces", "error_traces", "avg", "min", "max", *points)
    return out.withColumn("error_percent", percent(F.col("error_traces"), F.col("traces")))


def trace_table(spans: DataFrame) -> DataFrame:
    """Per trace: bounds, duration, spans, error spans, services, root service and operation."""
    end = F.unix_micros(F.col("start_ts").cast("timestamp")) + (F.col("duration_ms") * 1000).cast("long")
    root = F.min_by(F.struct("service", "operation", "duration_ms"), F.struct(F.col("parent_span_id").isNotNull(), "start_ts", "span_id"))
    out = spans.groupBy("trace_id").agg(
        F.min("start_ts").alias("start_ts"), F.max(end).alias("_end"), F.min(F.unix_micros(F.col("start_ts").cast("timestamp"))).alias("_start"), F.count("*").alias("span_count"),
        F.count_if("is_error").alias("error_count"), F.count_distinct("service").alias("services"), F.sum("duration_ms").alias("total_ms"), root.alias("_root"),
    )
    return out.select(
        "trace_id", "start_ts", ((F.col("_end") - F.col("_start")) / 1000.0).alias("duration_ms"), "span_count", "error_count", (F.col("error_count") > 0).alias("has_error"), "services", "total_ms",
        F.col("_root.service").alias("root_service"), F.col("_root.operation").alias("root_operation"), F.col("_root.duration_ms").alias("root_ms"),
    )


def trace_stats(spans: DataFrame) -> DataFrame:
    t = trace_table(spans)
    return t.agg(F.count("*").alias("traces"), F.avg("duration_ms").alias("avg"), F.min("duration_ms").alias("min"), F.max("duration_ms").alias("max"), ratio(F.count_if("has_error"), F.count("*")).alias("error_share"), F.avg("span_count").alias("mean_spans"))


def trace_patterns(spans: DataFrame) -> DataFrame:
    """Signature = sorted ``service:operation`` list: count, mean duration, error rate, first examples."""
    parts = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "service", "operation"))), "|")
    per = spans.groupBy("trace_id").agg(parts.alias("pattern"), F.sum("duration_ms").alias("total_ms"), F.max("is_error").alias("has_error"))
    return per.groupBy("pattern").agg(F.count("*").alias("count"), F.avg("total_ms").alias("avg"), ratio(F.count_if("has_error"), F.count("*")).alias("error_rate"), F.min("trace_id").alias("example"))


def timeline(spans: DataFrame) -> DataFrame:
    """Offsets of each span's start and end from its trace's first start."""
    micros = F.unix_micros(F.col("start_ts").cast("timestamp"))
    offset = (micros - F.min(micros).over(Window.partitionBy("trace_id"))) / 1000.0
    return spans.select("trace_id", "span_id", offset.alias("offset_ms"), (offset + F.col("duration_ms")).alias("end_ms"), F.when(F.col("is_error"), "ERROR").otherwise("OK").alias("status"))


def slow_traces(spans: DataFrame, p: float = 0.95, share: float = 0.9) -> DataFrame:
    """Traces whose summed duration reaches ``share`` of the percentile of all traces."""
    totals = spans.groupBy("trace_id").agg(F.sum("duration_ms").alias("total_ms"))
    cut = F.broadcast(totals.agg(F.percentile("total_ms", F.lit(p)).alias("_cut")))
    return totals.crossJoin(cut).filter(F.col("total_ms") >= share * F.col("_cut")).select("trace_id", "total_ms")


def list_services(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Services of both signals with their counts."""
    a = spans.groupBy("service").agg(F.count("*").alias("spans"), F.min("start_ts").alias("first_span"))
    b = logs.groupBy("service").agg(F.count("*").alias("logs"))
    return a.join(b, "service", "full_outer").fillna(0, ["spans", "logs"])


def error_traces(spans: DataFrame, service: str | None = None, error_type: str | None = None) -> DataFrame:
    """Traces with errors: earliest error, error types, error spans."""
    e = spans.filter("is_error")
    if service:
        e = e.filter(F.col("service") == service)
    if error_type:
        e = e.filter(F.col("error_type") == error_type)
    return e.groupBy("trace_id").agg(F.count("*").alias("errors"), F.min("start_ts").alias("first_error"), F.sort_array(F.collect_set("error_type")).alias("types"))
