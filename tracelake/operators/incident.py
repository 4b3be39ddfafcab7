"""Incidents: what went wrong around a moment, which known patterns it matches, how severe it is, and the system's health.

Known patterns are rows of a rule table that the caller may replace. What is observed is one
long table (signal, subject, value), so a rule is a row of a join, whatever it looks at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.stats import percent, rank_percentiles, ratio
from tracelake.functions.timeutil import bucket

_K = F.col

#: Fixed values of the known patterns: pattern, confidence, check, signal, subject, comparison, limit, weight.
#: A check's match is the weighted share of its rules that hold, a pattern's match the mean over its checks.
RULES = (
    ("Database connection pool exhaustion", "high", "messages", "message", "connection pool", ">", 0.0, 1.0),
    ("Database connection pool exhaustion", "high", "messages", "message", "timeout", ">", 0.0, 1.0),
    ("Database connection pool exhaustion", "high", "messages", "message", "database", ">", 0.0, 1.0),
    ("Database connection pool exhaustion", "high", "latency", "p99_ms", None, ">", 2000.0, 1.0),
    ("Database connection pool exhaustion", "high", "errors", "error_rate", None, ">=", 0.3, 1.0),
    ("Database connection pool exhaustion", "high", "services", "failing_service", "database", ">", 0.0, 1.0),
    ("Database connection pool exhaustion", "high", "services", "failing_service", "api", ">", 0.0, 1.0),
    ("API rate limiting", "high", "messages", "message", "rate limit", ">", 0.0, 1.0),
    ("API rate limiting", "high", "messages", "message", "429", ">", 0.0, 1.0),
    ("API rate limiting", "high", "messages", "message", "too many requests", ">", 0.0, 1.0),
    ("Memory leak", "medium", "memory", "memory_max", None, ">=", 0.8, 1.0),
    ("Distributed deadlock", "medium", "messages", "message", "deadlock", ">", 0.0, 1.0),
    ("Distributed deadlock", "medium", "messages", "message", "lock timeout", ">", 0.0, 1.0),
    ("Distributed deadlock", "medium", "messages", "message", "transaction", ">", 0.0, 1.0),
    ("Distributed deadlock", "medium", "latency", "p99_ms", None, ">", 2000.0, 1.0),
    ("Distributed deadlock", "medium", "services", "failing_services", None, ">", 2.0, 1.0),
    ("Service failure", "high", "errors", "error_rate", None, ">", 0.1, 1.0),
    ("CPU exhaustion", "medium", "cpu", "cpu_max", None, ">", 0.8, 1.0),
    ("Memory exhaustion", "medium", "memory", "memory_max", None, ">", 0.9, 1.0),
    ("Cascading failure", "medium", "services", "failing_services", None, ">", 3.0, 1.0),
)
RULE_COLUMNS = "pattern string, confidence string, check string, signal string, subject string, comparison string, limit double, weight double"
#: A pattern is a hypothesis above this match.
MATCH = 0.7
#: Metrics that tell of CPU and memory, as shares of one.
RESOURCES = {"cpu": "system.cpu.total.norm.pct", "memory": "system.memory.actual.used.pct"}
_ERRORS = ("error", "fatal")


def _is_error_log() -> Column:
    return F.lower("level").isin(*_ERRORS)


def around(df: DataFrame, ts: str, at: str, before: int = 15, after: int = 15) -> DataFrame:
    """Rows from ``before`` minutes before a moment to ``after`` minutes after it, ends included."""
    moment, minutes = F.lit(at).cast("timestamp_ntz"), lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))
    return df.filter((_K(ts) >= moment - minutes(before)) & (_K(ts) <= moment + minutes(after)))


# what went wrong ------------------------------------------------------------------------


def error_samples(spans: DataFrame, samples: int = 5) -> DataFrame:
    """Errors by service and operation with the ids of the traces that have most of them (ties by id)."""
    per = spans.filter("is_error").groupBy("service", "operation", "trace_id").agg(F.count("*").alias("c"))
    place = Window.partitionBy("service", "operation").orderBy(F.desc("c"), "trace_id")
    top = per.withColumn("r", F.row_number().over(place)).filter(_K("r") <= samples)  # the engine keeps so many rows of a group before it shuffles
    top = top.groupBy("service", "operation").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "trace_id"))), lambda x: x["trace_id"]).alias("samples"))
    return per.groupBy("service", "operation").agg(F.sum("c").alias("errors"), F.count("*").alias("traces")).join(top, ["service", "operation"])


def minutes_of(spans: DataFrame, logs: DataFrame, seconds: int = 60) -> DataFrame:
    """bucket, spans, errors, p95, p99, logs, and the logs of each level as a map."""
    s = spans.groupBy(bucket(_K("start_ts"), seconds).alias("bucket")).agg(F.count("*").alias("spans"), F.count_if("is_error").alias("errors"), *[F.percentile("duration_ms", F.lit(p / 100)).alias(f"p{p}") for p in (95, 99)])
    per = logs.groupBy(bucket(_K("ts"), seconds).alias("bucket"), "level").agg(F.count("*").alias("n"))
    g = per.groupBy("bucket").agg(F.sum("n").alias("logs"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("levels"))
    return s.join(g, "bucket", "full_outer").fillna(0, ["spans", "errors", "logs"])


def top_error_messages(logs: DataFrame, n: int = 20) -> DataFrame:
    return logs.filter(_is_error_log()).groupBy("message").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "message").limit(n)


def metric_stats(metrics: DataFrame, seconds: int = 60) -> DataFrame:
    """Per metric: count, min, max, mean and std of its rows, its busiest bucket, and whether a row passes mean + 2 std."""
    v = _K("value")
    per = metrics.groupBy("metric", bucket(_K("ts"), seconds).alias("b")).agg(F.avg("value").alias("m")).groupBy("metric").agg(F.max_by("b", F.struct("m", "b")).alias("peak"))
    return metrics.groupBy("metric").agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).withColumn("anomalous", _K("max") > _K("mean") + 2 * _K("std")).join(per, "metric")


# hypotheses -----------------------------------------------------------------------------


def observed(spans: DataFrame, logs: DataFrame, metrics: DataFrame, rules: Sequence[tuple] = RULES, resources: Mapping[str, str] = RESOURCES, seconds: int = 60) -> DataFrame:
    """signal, subject, value: one row for each thing that the rules may look at.

    ``message`` counts error logs that hold the subject, ``failing_service`` services with errors
    whose name holds it; ``error_rate`` is a share of one, ``p99_ms`` the worst bucket's.
    """
    said = sorted({r[4] for r in rules if r[3] == "message"})
    named = sorted({r[4] for r in rules if r[3] == "failing_service"})

    def long(one: DataFrame, rows: list[tuple[str, str | None, Column]]) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(x).cast("string").alias("subject"), v.cast("double").alias("value")) for s, x, v in rows])
        return one.select(F.explode(parts).alias("o")).select("o.*")

    holds = lambda c, x: F.contains(F.lower(c), F.lit(x.lower()))
    messages = logs.filter(_is_error_log()).agg(F.count("*").alias("all"), *[F.count_if(holds("message", x)).alias(f"m{i}") for i, x in enumerate(said)])
    per = spans.groupBy("service").agg(F.count("*").alias("n"), F.count_if("is_error").alias("e"))
    failing = per.agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.count_if(_K("e") > 0).alias("s"), *[F.count_if((_K("e") > 0) & holds("service", x)).alias(f"s{i}") for i, x in enumerate(named)])
    worst = spans.groupBy(bucket(_K("start_ts"), seconds).alias("b")).agg(F.percentile("duration_ms", F.lit(0.99)).alias("p")).agg(F.max("p").alias("p"))
    use = metrics.agg(*[F.max(F.when(_K("metric") == m, _K("value"))).alias(k) for k, m in resources.items()])
    out = long(messages, [("error_logs", None, _K("all")), *[("message", x, _K(f"m{i}")) for i, x in enumerate(said)]])
    out = out.unionByName(long(failing, [("error_rate", None, ratio(_K("e"), _K("n"))), ("failing_services", None, _K("s")), *[("failing_service", x, _K(f"s{i}")) for i, x in enumerate(named)]]))
    return out.unionByName(long(worst, [("p99_ms", None, _K("p"))])).unionByName(long(use, [(f"{k}_max", None, _K(k)) for k in resources]))


def rule_table(spark, rules: Sequence[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_COLUMNS)


def pattern_matches(seen: DataFrame, rules: DataFrame) -> DataFrame:
    """pattern, confidence, match, checks, evidence (the rules that hold) of every pattern; what isn't observed doesn't hold."""
    x, y = _K("value"), _K("limit")
    holds = F.coalesce(F.when(_K("comparison") == ">", x > y).when(_K("comparison") == ">=", x >= y).when(_K("comparison") == "<", x < y).when(_K("comparison") == "<=", x <= y).otherwise(F.raise_error(F.concat(F.lit("no comparison: "), "comparison")).cast("boolean")), F.lit(False))
    joined = rules.join(seen.withColumnsRenamed({"signal": "_g", "subject": "_s"}), (_K("signal") == _K("_g")) & _K("subject").eqNullSafe(_K("_s")), "left").withColumn("ok", holds)
    told = F.when(_K("ok"), F.concat_ws(" ", F.concat_ws(":", "signal", "subject"), "comparison", _K("limit").cast("string")))
    check = joined.groupBy("pattern", "confidence", "check").agg(ratio(F.sum(F.when(_K("ok"), _K("weight")).otherwise(0.0)), F.sum("weight")).alias("share"), F.collect_list(told).alias("told"))
    return check.groupBy("pattern", "confidence").agg(F.avg("share").alias("match"), F.count("*").alias("checks"), F.array_sort(F.flatten(F.collect_list("told"))).alias("evidence"))


def hypotheses(spans: DataFrame, logs: DataFrame, metrics: DataFrame, rules: Sequence[tuple] = RULES, resources: Mapping[str, str] = RESOURCES, seconds: int = 60, least: float = MATCH) -> DataFrame:
    """The patterns that match by more than ``least``."""
    return pattern_matches(observed(spans, logs, metrics, rules, resources, seconds), rule_table(spans.sparkSession, rules)).filter(_K("match") > least)


# severity and health --------------------------------------------------------------------


def severity_factors(spans: DataFrame, metrics: DataFrame, resources: Mapping[str, str] = RESOURCES) -> DataFrame:
    """factor, value, points of error share (.5/.2/.05: 3/2/1), failing services (5/2: 3/2), CPU (.9/.8) and memory (.95/.9) together (3/2)."""
    s = spans.agg(ratio(F.count_if("is_error"), F.count("*")).alias("e"), F.count_distinct(F.when(_K("is_error"), _K("service"))).alias("s"))
    m = metrics.agg(*[F.coalesce(F.max(F.when(_K("metric") == resources[k], _K("value"))), F.lit(0.0)).cast("double").alias(k) for k in ("cpu", "memory")])
    full = F.when((_K("cpu") > 0.9) | (_K("memory") > 0.95), 3).when((_K("cpu") > 0.8) | (_K("memory") > 0.9), 2).otherwise(0)
    rows = [
        ("error_rate", _K("e"), F.when(_K("e") > 0.5, 3).when(_K("e") > 0.2, 2).when(_K("e") > 0.05, 1).otherwise(0)),
        ("service_spread", _K("s"), F.when(_K("s") > 5, 3).when(_K("s") > 2, 2).otherwise(0)), ("resource_exhaustion", F.greatest("cpu", "memory"), full),
    ]
    parts = F.array(*[F.struct(F.lit(n).alias("factor"), v.cast("double").alias("value"), p.cast("int").alias("points")) for n, v, p in rows])
    return s.crossJoin(F.broadcast(m)).select(F.explode(parts).alias("f")).select("f.*")


def severity(factors: DataFrame) -> DataFrame:
    """One row: score and level (7/5/3)."""
    return factors.agg(F.sum("points").alias("score")).withColumn("level", F.when(_K("score") >= 7, "critical").when(_K("score") >= 5, "high").when(_K("score") >= 3, "medium").otherwise("low"))


def bottlenecks(spans: DataFrame, edges: DataFrame, busiest: int = 3, many: int = 10_000, errors: float = 5.0, operations: int = 20) -> DataFrame:
    """kind, name, value: operations (of the commonest ones) slower on average than the overall p95, edges with errors, the busiest edges beyond ``many`` calls."""
    top = spans.groupBy("operation").agg(F.count("*").alias("n"), F.avg("duration_ms").cast("double").alias("avg")).orderBy(F.desc("n"), "operation").limit(operations)
    slow = top.crossJoin(F.broadcast(rank_percentiles(spans, [], "duration_ms", {"p95": 0.95}))).filter(_K("avg") > _K("p95")).select(F.lit("high_latency").alias("kind"), _K("operation").alias("name"), _K("avg").alias("value"))
    name = F.concat_ws(" -> ", "source", "target")
    failing = edges.filter(_K("error_rate") > errors).select(F.lit("high_error_rate").alias("kind"), name.alias("name"), _K("error_rate").alias("value"))
    busy = edges.orderBy(F.desc("call_count"), "source", "target").limit(busiest).filter(_K("call_count") > many).select(F.lit("high_volume").alias("kind"), name.alias("name"), _K("call_count").cast("double").alias("value"))
    return slow.unionByName(failing).unionByName(busy)


def health_summary(spans: DataFrame, logs: DataFrame, metrics: DataFrame, edges: DataFrame, resources: Mapping[str, str] = RESOURCES, many: int = 10_000) -> DataFrame:
    """One row: error % of traces, log error %, logs by level, CPU and memory mean and max, bottlenecks, score 100 - min(2e, 40) - min(l, 20) - min(5b, 20), status 90/70/50."""
    traces = spans.filter(_K("trace_id").isNotNull()).groupBy("trace_id").agg(F.max("is_error").alias("_e"))
    s = traces.agg(F.count("*").alias("traces"), F.count_if("_e").alias("_e")).select("traces", percent(_K("_e"), _K("traces")).alias("error_percent"))
    lg = logs.groupBy("level").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("levels"), percent(F.sum(F.when(_is_error_log(), _K("n")).otherwise(0)), F.sum("n")).alias("log_error_percent"))
    m = metrics.agg(*[f(F.when(_K("metric") == resources[k], _K("value"))).cast("double").alias(f"{k}_{n}") for k in ("cpu", "memory") for n, f in (("mean", F.avg), ("max", F.max))]).fillna(0.0)
    b = bottlenecks(spans, edges, many=many).agg(F.count("*").alias("bottlenecks"), F.count_if(_K("kind") == "high_latency").alias("slow_operations"))
    score = F.round(F.greatest(F.lit(0.0), 100 - F.least(_K("error_percent") * 2, F.lit(40.0)) - F.least("log_error_percent", F.lit(20.0)) - F.least(_K("bottlenecks") * 5, F.lit(20))))
    out = s.crossJoin(F.broadcast(lg)).crossJoin(F.broadcast(m)).crossJoin(F.broadcast(b)).withColumn("score", score)
    return out.withColumn("status", F.when(_K("score") >= 90, "healthy").when(_K("score") >= 70, "degraded").when(_K("score") >= 50, "unhealthy").otherwise("critical"))


# retries --------------------------------------------------------------------------------


def retry_impact(storms: DataFrame, retries: int = 3, base_ms: float = 100.0, delay_ms: float = 1000.0, per_request: float = 0.0001) -> DataFrame:
    """One row over retry_storms(): what is wasted and costs, success rate, latency that retries add, and how far they may amplify.

    The amplification is the product over the storms of 1.5, 1.3 or 1.1 (ratio above 5, 3 or 2), ten at most.
    """
    times = F.when(_K("ratio") > 5, 1.5).when(_K("ratio") > 3, 1.3).when(_K("ratio") > 2, 1.1).otherwise(1.0)
    g = storms.agg(
        F.count("*").alias("storms"), F.count_distinct("service").alias("services"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.exp(F.sum(F.log(times))), F.lit(1.0)).alias("_product"), F.coalesce(F.bool_or(_K("severity") == "critical"), F.lit(False)).alias("_critical"),
    )
    wasted = _K("retries") * (retries - 1)
    return g.select(
        "storms", "services", wasted.alias("wasted"), percent(wasted, _K("requests")).alias("wasted_percent"), (wasted * per_request).alias("compute_cost"), (wasted * per_request * 1.3).alias("total_cost"),
        percent(_K("requests") - _K("retries"), _K("requests")).alias("success_rate"), F.lit(base_ms * retries + delay_ms * (retries - 1)).alias("added_ms"), F.lit(base_ms * retries * 2 + delay_ms * (retries - 1)).alias("added_p95_ms"),
        F.when(_K("retries") > 10_000, "high").when(_K("retries") > 1000, "medium").otherwise("low").alias("user_impact"), F.when(_K("_critical"), "high").when(_K("storms") > 5, "medium").otherwise("low").alias("cascading_risk"),
        F.least(_K("_product"), F.lit(10.0)).alias("amplification"),
    )
