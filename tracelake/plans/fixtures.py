"""Spans, logs and metrics derived from the given tables, as DataFrames and as SQL text.

Both dialects run the same text, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.functions.lineage import cut_lineage

TABLES = ("orders", "lineitem", "events", "documents", "embeddings", "conversations", "supplier", "part", "customer", "nation", "region")

SPANS = """
line AS (
  SELECT l_orderkey, l_linenumber, min(l_suppkey) AS sk, min(l_partkey) AS pk, sum(l_quantity) AS q,
         max(l_returnflag) AS rf, min(l_linestatus) AS ls, min(l_shipdate) AS sd
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
spans AS (
  SELECT CAST(o_orderkey AS VARCHAR(32)) AS trace_id, concat(CAST(o_orderkey AS VARCHAR(32)), '-0') AS span_id,
         CAST(NULL AS VARCHAR(32)) AS parent_span_id, 'gateway' AS service, o_orderpriority AS operation,
         o_orderdate AS start_ts, o_totalprice / 100.0 AS duration_ms,
         (o_orderstatus = 'F' AND o_orderkey % 5 = 0) AS is_error,
         CAST(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'Timeout' END AS VARCHAR(32)) AS error_type,
         0 AS line, CAST(o_custkey AS BIGINT) AS user_id
  FROM orders
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR(32)), concat(CAST(l_orderkey AS VARCHAR(32)), '-', CAST(l_linenumber AS VARCHAR(32))),
         concat(CAST(l_orderkey AS VARCHAR(32)), '-', CAST(CAST(floor(l_linenumber / 2) AS INT) AS VARCHAR(32))),
         concat('svc-', CAST(sk % 8 AS VARCHAR(32))), concat('op-', CAST(pk % 12 AS VARCHAR(32))), sd, q * 10.0,
         (rf = 'R' AND ls = 'F'),
         CAST(CASE WHEN rf = 'R' AND ls = 'F' THEN CASE WHEN pk % 3 = 0 THEN 'Timeout' WHEN pk % 3 = 1 THEN 'Connection' ELSE 'Memory' END END AS VARCHAR(32)),
         l_linenumber, CAST(sk AS BIGINT)
  FROM line)"""

LOGS = """
logs AS (
  SELECT ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
         concat('user ', CAST(user_id AS VARCHAR(32)), CASE event_type WHEN 'error' THEN ' failed request ' ELSE ' completed request ' END,
                CAST(event_id AS VARCHAR(32)), ' type ', event_type) AS message,
         concat('svc-', CAST(user_id % 8 AS VARCHAR(32))) AS service, CAST(event_id AS VARCHAR(32)) AS trace_id,
         CAST(event_id AS VARCHAR(32)) AS span_id, event_id, user_id, value, props
  FROM events)"""

METRICS = """
metrics AS (
  SELECT ts, event_type AS metric, concat('svc-', CAST(user_id % 8 AS VARCHAR(32))) AS service, value FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL text over the given tables; only those it names are registered."""
    import re

    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, f"WITH {SPANS} SELECT * FROM spans")


def spans_once(spark: SparkSession, sf_dir: str, *more: str, where: str = "true") -> DataFrame:
    """Ids, service, duration, error and ``more`` of the spans, derived once and read from the shared folder by whatever uses them several times."""
    return cut_lineage(spans(spark, sf_dir).filter(where).select("trace_id", "span_id", "parent_span_id", "service", "duration_ms", "is_error", *more))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, f"WITH {LOGS} SELECT * FROM logs")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, f"WITH {METRICS} SELECT * FROM metrics")
