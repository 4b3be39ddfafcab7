"""How costs run over hours and days, what retries come from, and what appears, vanishes or is rare."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.stats import percent, ratio
from tracelake.functions.timeutil import bucket
from tracelake.operators.reports import COST

_K = F.col


# costs ----------------------------------------------------------------------------------


def bucket_costs(spans: DataFrame, seconds: int = 86400, model: Mapping[str, float] = COST) -> DataFrame:
    """bucket, i (from 0), cost: compute and memory hours and requests (distinct traces)."""
    hours = F.sum("duration_ms") / 3_600_000
    cost = hours * (model["compute"] + model["memory_gb"] * model["memory"]) + F.count_distinct("trace_id") / 1e6 * model["requests"]
    per = spans.groupBy(bucket(_K("start_ts"), seconds).alias("bucket")).agg(cost.cast("double").alias("cost"))
    return per.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bucket")) - 1)  # a row a bucket


def cost_profile(costs: DataFrame) -> DataFrame:
    """unit (hour of day or ISO weekday), value, mean, factor over the overall mean, buckets."""
    units = F.array(F.struct(F.lit("hour").alias("unit"), F.hour("bucket").alias("value")), F.struct(F.lit("weekday").alias("unit"), (F.weekday("bucket") + 1).alias("value")))
    whole = F.broadcast(costs.agg(F.avg("cost").alias("_m")))
    g = costs.select(F.explode(units).alias("u"), "cost").groupBy("u.unit", "u.value").agg(F.avg("cost").alias("mean"), F.count("*").alias("buckets"))
    return g.crossJoin(whole).withColumn("factor", ratio(_K("mean"), _K("_m"))).drop("_m")


def cost_peaks(costs: DataFrame, n: int = 5) -> DataFrame:
    """bucket, cost, factor of the dearest buckets."""
    whole = F.broadcast(costs.agg(F.avg("cost").alias("_m")))
    return costs.orderBy(F.desc("cost"), "bucket").limit(n).crossJoin(whole).select("bucket", "cost", ratio(_K("cost"), _K("_m")).alias("factor"))


def cost_trend(costs: DataFrame, span: int = 7, ahead: int = 30) -> DataFrame:
    """One row: mean of the last ``span`` buckets and of those before, change in % and direction (5 %), forecast by the normalised slope, confidence."""
    last = F.broadcast(costs.agg(F.max("i").alias("_z"), ratio(F.regr_slope("cost", _K("i").cast("double")), F.avg("cost")).alias("slope"), F.max_by("cost", "i").alias("_last")))
    back = _K("_z") - _K("i")
    g = costs.crossJoin(last).groupBy("_z", "slope", "_last").agg(F.avg(F.when(back < span, _K("cost"))).alias("recent"), F.avg(F.when((back >= span) & (back < 2 * span), _K("cost"))).alias("previous"))
    g = g.withColumn("change", percent(_K("recent") - _K("previous"), _K("previous")))
    return g.select("recent", "previous", "change", F.when(_K("change") > 5, "increasing").when(_K("change") < -5, "decreasing").otherwise("stable").alias("direction"), "slope", (_K("_last") * (1 + _K("slope") * ahead)).alias("forecast"), F.when(F.abs("slope") < 0.1, "high").otherwise("medium").alias("confidence"))


# retries --------------------------------------------------------------------------------


def retry_root_causes(spans: DataFrame, storms: DataFrame, status: Column, shared: int = 2) -> DataFrame:
    """service, operation, role, cause, evidence, severity, common (more than ``shared`` storms have this primary cause) of the storms' failing spans.

    The commonest error type is a timeout or a lost connection (primary); 429 is rate limiting
    (primary), codes from 500 on are server errors (contributing).
    """
    keys = ["service", "operation"]
    rows = spans.withColumn("_code", status.cast("int")).join(storms.select(*keys).distinct(), keys, "left_semi")
    per = rows.filter(_K("error_type").isNotNull()).groupBy(*keys, "error_type").agg(F.count("*").alias("n"))
    top = per.groupBy(*keys).agg(F.max_by("error_type", F.struct("n", "error_type")).alias("t"), F.max("n").alias("n"))
    low = F.lower("t")
    kind = F.when(F.contains(low, F.lit("timeout")), "timeout").when(F.contains(low, F.lit("connection")), "connection_failure")
    first = top.withColumn("cause", kind).filter("cause is not null").select(*keys, F.lit("primary").alias("role"), "cause", _K("n").alias("evidence"), F.lit("high").alias("severity"))
    codes = rows.groupBy(*keys).agg(F.count_if(_K("_code") == 429).alias("limited"), F.count_if(_K("_code") >= 500).alias("failed"))
    long = F.array(F.struct(F.lit("primary").alias("role"), F.lit("rate_limiting").alias("cause"), _K("limited").alias("evidence"), F.lit("critical").alias("severity")), F.struct(F.lit("contributing").alias("role"), F.lit("server_errors").alias("cause"), _K("failed").alias("evidence"), F.lit("medium").alias("severity")))
    found = first.unionByName(codes.select(*keys, F.explode(long).alias("c")).select(*keys, "c.*").filter("evidence > 0"))
    same = found.filter("role = 'primary'").groupBy("cause").agg((F.count("*") > shared).alias("common"))
    return found.join(F.broadcast(same), "cause", "left").withColumn("common", (_K("role") == "primary") & F.coalesce("common", F.lit(False)))  # a row a cause


# services, templates, attributes --------------------------------------------------------


def service_changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """service, state (added or removed): services of the edges of one period only."""
    of = lambda e: e.select(F.explode(F.array("source", "target")).alias("service")).distinct()
    a, b = of(current).withColumn("a", F.lit(1)), of(baseline).withColumn("b", F.lit(1))
    return a.join(b, "service", "full_outer").filter("a is null or b is null").select("service", F.when(_K("b").isNull(), "added").otherwise("removed").alias("state"))


def rare_templates(logs: DataFrame, template: Column, share: float = 0.001, least: int = 2, n: int = 50) -> DataFrame:
    """template, count, errors, share: templates below a share that still occur ``least`` times, those with errors first, then the rarest."""
    per = logs.groupBy(template.alias("template")).agg(F.count("*").alias("count"), F.count_if(F.lower("level").isin("error", "fatal")).alias("errors"))
    whole = F.broadcast(logs.agg(F.count("*").alias("_all")))
    rows = per.crossJoin(whole).withColumn("share", ratio(_K("count"), _K("_all"))).filter((_K("share") < share) & (_K("count") >= least)).drop("_all")
    return rows.orderBy(F.desc(_K("errors") > 0), "count", "template").limit(n)


def attribute_values(df: DataFrame, attributes: str, n: int = 10) -> DataFrame:
    """key, rows (that have it), values (distinct), value, count, rank of the commonest values of each attribute."""
    per = df.select(F.explode(attributes).alias("key", "value")).filter("value is not null").groupBy("key", "value").agg(F.count("*").alias("count"))
    key = Window.partitionBy("key")
    out = per.withColumn("rows", F.sum("count").over(key)).withColumn("values", F.count("*").over(key)).withColumn("rank", F.row_number().over(key.orderBy(F.desc("count"), "value")))
    return out.filter(_K("rank") <= n).select("key", "rows", "values", "value", "count", "rank")
