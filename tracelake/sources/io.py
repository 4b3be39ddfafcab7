"""Readers, writers, alias normalisation and streams for spans, logs and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN_SCHEMA = (
    "trace_id string, span_id string, parent_span_id string, service string, operation string, start_ts timestamp, duration_ms double, is_error boolean, status string, error_type string, error_message string, "
    "http_url string, http_status int, http_retry boolean, http_retry_count int, attributes map<string,string>, events array<struct<name:string,ts:timestamp,attributes:map<string,string>>>"
)
LOG_SCHEMA = "ts timestamp, level string, message string, service string, trace_id string, span_id string, attributes map<string,string>"
METRIC_SCHEMA = "ts timestamp, metric string, service string, value double, attributes map<string,string>"

# fixed values: names under which the fields are met
ALIASES = {
    "trace_id": ("trace_id", "traceId", "trace.id", "TraceId"),
    "span_id": ("span_id", "spanId", "span.id", "SpanId"),
    "parent_span_id": ("parent_span_id", "parentSpanId", "span.parent_id", "ParentSpanId"),
    "service": ("service", "service.name", "resource.service.name", "resource.attributes.service.name", "Resource.service.name"),
    "operation": ("operation", "name", "span.name", "operationName", "Name"),
    "ts": ("ts", "@timestamp", "timestamp", "startTime", "start_time"),
    "start_ts": ("start_ts", "@timestamp", "startTime", "start_time", "timestamp"),
    "level": ("level", "SeverityText", "severity.text", "severity"),
    "message": ("message", "Body", "body"),
    "error_type": ("error_type", "error.type"),
    "error_message": ("error_message", "error.message"),
    "http_url": ("http_url", "http.url"),
    "http_status": ("http_status", "http.status_code"),
    "http_retry": ("http_retry", "http.retry"),
    "http_retry_count": ("http_retry_count", "http.retry_count"),
}


def _paths(schema: T.StructType, prefix: str = "") -> dict[str, str]:
    """Dotted name -> quoted column path of every field."""
    out: dict[str, str] = {}
    for f in schema.fields:
        dotted = f"{prefix}.{f.name}" if prefix else f.name
        quoted = ".".join(f"`{p}`" for p in [*(prefix.split(".") if prefix else []), f.name]) if prefix else f"`{f.name}`"
        out[dotted] = quoted
        if isinstance(f.dataType, T.StructType) and "." not in f.name:
            out |= {k: v for k, v in _paths(f.dataType, dotted).items() if k not in out}
    return out


def alias(df: DataFrame, field: str, otherwise: Column | None = None) -> Column:
    """The first of the field's known names that the rows have."""
    paths = _paths(df.schema)
    found = [F.col(paths[a]) for a in ALIASES[field] if a in paths and not isinstance(df.select(paths[a]).schema[0].dataType, (T.StructType, T.MapType))]
    if otherwise is not None:
        found.append(otherwise)
    return F.coalesce(*found) if found else F.lit(None)


def _rest(df: DataFrame, used: set[str]) -> Column:
    """All other top-level columns folded into one map, with the rows' own attributes first."""
    own = [F.col("attributes")] if "attributes" in df.columns and isinstance(df.schema["attributes"].dataType, T.MapType) else []
    other = [c for c in df.columns if c not in used and c != "attributes" and not isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))]
    if other:
        pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in other]), lambda p: p["v"].isNotNull())
        own.append(F.map_from_entries(pairs))
    if not own:
        return F.create_map().cast("map<string,string>")
    out = own[0] if len(own) == 1 else F.map_concat(F.coalesce(own[0], F.create_map().cast("map<string,string>")), F.map_filter(own[1], lambda k, v: ~F.array_contains(F.coalesce(F.map_keys(own[0]), F.array().cast("array<string>")), k)))
    return out


def _used(fields: Sequence[str]) -> set[str]:
    return {a for f in fields for a in ALIASES[f]}


def normalize_spans(df: DataFrame, duration_unit: str = "ms") -> DataFrame:
    """Any known spelling -> the canonical span columns; durations in ms, ``is_error`` set once."""
    paths = _paths(df.schema)
    scale = {"ms": 1.0, "us": 1000.0, "ns": 1e6}[duration_unit]
    given = next((F.col(paths[p]).cast("double") / scale for p in ("duration", "Duration") if p in paths), F.lit(None).cast("double"))
    own = F.col(paths["duration_ms"]).cast("double") if "duration_ms" in paths else F.lit(None).cast("double")
    start = alias(df, "start_ts").cast("timestamp")
    end = next((F.col(paths[p]).cast("timestamp") for p in ("endTime", "end_time", "end_ts") if p in paths), None)
    length = (F.unix_micros(end) - F.unix_micros(start)) / 1000.0 if end is not None else F.lit(None).cast("double")
    code = F.lower(F.coalesce(*[F.col(paths[p]).cast("string") for p in ("status.code", "status") if p in paths and not isinstance(df.select(paths[p]).schema[0].dataType, T.StructType)], F.lit(""))) if {"status.code", "status"} & set(paths) else F.lit("")
    flag = F.coalesce(F.col(paths["error"]).cast("boolean"), F.lit(False)) if "error" in paths and not isinstance(df.select(paths["error"]).schema[0].dataType, T.StructType) else F.lit(False)
    known = F.coalesce(F.col("is_error"), F.lit(False)) if "is_error" in df.columns else F.lit(False)
    is_error = code.isin("2", "error") | flag | known
    fields = ("trace_id", "span_id", "parent_span_id", "service", "operation", "start_ts", "error_type", "error_message", "http_url", "http_status", "http_retry", "http_retry_count")
    used = _used(fields) | {"duration", "Duration", "duration_ms", "endTime", "end_time", "end_ts", "status", "status.code", "error", "is_error", "events"}
    parent, span = alias(df, "parent_span_id").cast("string"), alias(df, "span_id").cast("string")
    events = F.col("events") if "events" in df.columns else F.lit(None).cast("array<struct<name:string,ts:timestamp,attributes:map<string,string>>>")
    return df.select(
        alias(df, "trace_id").cast("string").alias("trace_id"), span.alias("span_id"), F.when((parent != span) & (parent != ""), parent).alias("parent_span_id"),
        alias(df, "service", F.lit("unknown")).cast("string").alias("service"), alias(df, "operation").cast("string").alias("operation"), start.alias("start_ts"),
        F.coalesce(own, given, length).alias("duration_ms"), is_error.alias("is_error"), F.when(is_error, "ERROR").when(code.isin("1", "ok"), "OK").otherwise("UNSET").alias("status"),
        alias(df, "error_type").cast("string").alias("error_type"), alias(df, "error_message").cast("string").alias("error_message"), alias(df, "http_url").cast("string").alias("http_url"),
        alias(df, "http_status").cast("int").alias("http_status"), alias(df, "http_retry").cast("boolean").alias("http_retry"), alias(df, "http_retry_count").cast("int").alias("http_retry_count"),
        _rest(df, used).alias("attributes"), events.alias("events"),
    )


def normalize_logs(df: DataFrame) -> DataFrame:
    """Any known spelling -> ts, level (default info), message (default empty), service, ids, attributes."""
    fields = ("ts", "level", "message", "service", "trace_id", "span_id")
    return df.select(
        alias(df, "ts").cast("timestamp").alias("ts"), alias(df, "level", F.lit("info")).cast("string").alias("level"), alias(df, "message", F.lit("")).cast("string").alias("message"),
        *(alias(df, f).cast("string").alias(f) for f in ("service", "trace_id", "span_id")), _rest(df, _used(fields)).alias("attributes"),
    )


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def _scan(df: DataFrame, ts: str, start, end, size: int | None, offset: int, sort: Sequence[Column] | None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end))
    if sort:
        df = df.orderBy(*sort)
    if offset:
        df = df.offset(offset)
    return df.limit(size) if size is not None else df


def read_spans(spark: SparkSession, path: str, fmt: str = "parquet", start=None, end=None, size: int | None = None, offset: int = 0, sort=None) -> DataFrame:
    """Canonical spans of a time range; no size means all rows."""
    return _scan(normalize_spans(read_table(spark, path, fmt)), "start_ts", start, end, size, offset, sort)


def read_logs(spark: SparkSession, path: str, fmt: str = "parquet", start=None, end=None, size: int | None = None, offset: int = 0, sort=None) -> DataFrame:
    return _scan(normalize_logs(read_table(spark, path, fmt)), "ts", start, end, size, offset, sort)


def read_metrics(spark: SparkSession, path: str, fmt: str = "parquet", start=None, end=None, size: int | None = None, offset: int = 0, sort=None) -> DataFrame:
    return _scan(read_table(spark, path, fmt), "ts", start, end, size, offset, sort)


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each metric column; empty ones are left out."""
    return df.unpivot(list(ids), list(columns), "metric", "value").filter(F.col("value").isNotNull())


def stream_table(spark: SparkSession, path: str, schema: T.StructType | str, ts: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A file stream whose event time is a TIMESTAMP, as watermarks need it."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.load(path)
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def signal_availability(spans: DataFrame, logs: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row per signal: rows, first and last time."""
    out = None
    for name, df, ts in (("spans", spans, "start_ts"), ("logs", logs, "ts"), ("metrics", metrics, "ts")):
        one = df.agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(F.lit(name).alias("signal"), "*")
        out = one if out is None else out.unionByName(one)
    return out
