"""What a service's traffic, errors, resources and anomalies look like; every part is one aggregate or two for all services at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.stats import grade, percent, ratio
from tracelake.functions.timeutil import bucket

_K = F.col
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))


def _top(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", place).filter(_K("rank") <= n)


def log_levels(logs: DataFrame) -> DataFrame:
    """service, level, n, share of the service's logs in %."""
    per = logs.groupBy("service", "level").agg(F.count("*").alias("n"))
    return per.withColumn("share", percent(_K("n"), F.sum("n").over(Window.partitionBy("service"))))


def traffic_breakdown(spans: DataFrame, by: Column, n: int = 10) -> DataFrame:
    """service, value, requests, share in %, errors, rank: the commonest values (operations, clients, URLs) of each service, ties by value."""
    per = spans.select("service", by.alias("value"), "is_error").groupBy("service", "value").agg(F.count("*").alias("requests"), F.count_if("is_error").alias("errors"))
    per = per.withColumn("share", percent(_K("requests"), F.sum("requests").over(Window.partitionBy("service"))))
    return _top(per, ["service"], [F.desc("requests"), _K("value")], n)


def significant_values(spans: DataFrame, by: Column, n: int = 10, least: int = 2) -> DataFrame:
    """service, value, n, score, rank: values that a service has more of than all have; (fg - bg) fg / bg of the shares."""
    per = spans.select("service", by.alias("value")).groupBy("service", "value").agg(F.count("*").alias("n"))
    rows = per.withColumn("fg", ratio(_K("n"), F.sum("n").over(Window.partitionBy("service"))))
    total = F.broadcast(per.agg(F.sum("n").alias("_all")))
    every = per.groupBy("value").agg(F.sum("n").alias("_of"))
    rows = rows.join(every, "value").crossJoin(total).withColumn("bg", ratio(_K("_of"), _K("_all"))).filter((_K("fg") > _K("bg")) & (_K("n") >= least))
    return _top(rows.select("service", "value", "n", ((_K("fg") - _K("bg")) * ratio(_K("fg"), _K("bg"))).alias("score")), ["service"], [F.desc("score"), _K("value")], n)


def peak_hours(spans: DataFrame) -> DataFrame:
    """service, hour, requests of the hours of day above the 75th percentile of the service's hours."""
    per = spans.groupBy("service", F.hour("start_ts").alias("hour")).agg(F.count("*").alias("requests"))
    line = per.groupBy("service").agg(F.percentile("requests", F.lit(0.75)).alias("line"))
    return per.join(line, "service").filter(_K("requests") > _K("line")).drop("line")


def error_timeline(spans: DataFrame, seconds: int) -> DataFrame:
    """service, bucket, errors, error_rate of buckets with requests."""
    g = spans.groupBy("service", bucket(_K("start_ts"), seconds).alias("bucket")).agg(F.count_if("is_error").alias("errors"), percent(F.count_if("is_error"), F.count("*")).alias("error_rate"))
    return g


def error_trends(timeline: DataFrame, flat: float = 0.1) -> DataFrame:
    """service, slope (of the error rate over its mean, a bucket), trend."""
    i = F.row_number().over(Window.partitionBy("service").orderBy("bucket")).cast("double")
    g = timeline.withColumn("i", i).groupBy("service").agg(ratio(F.regr_slope("error_rate", "i"), F.avg("error_rate")).alias("slope"))
    return g.withColumn("trend", F.when(_K("slope") > flat, "increasing").when(_K("slope") < -flat, "decreasing").otherwise("stable"))


def error_attributes(spans: DataFrame, attributes: Mapping[str, Column], least: int = 5) -> DataFrame:
    """service, attribute, value, errors, rate, lift: values whose error rate is above their service's, at least ``least`` errors."""
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), c.cast("string").alias("value")) for n, c in attributes.items()])).alias("a")
    per = spans.select("service", "is_error", long).filter("a.value is not null").groupBy("service", "a.attribute", "a.value").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"))
    own = spans.groupBy("service").agg(ratio(F.count_if("is_error"), F.count("*")).alias("base"))
    rows = per.join(own, "service").withColumn("rate", ratio(_K("errors"), _K("n"))).withColumn("lift", ratio(_K("rate"), _K("base")))
    return rows.filter((_K("errors") >= least) & (_K("lift") > 1)).select("service", "attribute", "value", "errors", "rate", "lift")


def resource_efficiency(metrics: DataFrame, cpu: str, memory: str, scale: float = 1.0) -> DataFrame:
    """service, mean, std and max of both resources (shares of ``scale``), class of use, efficiency = (1 - mean use) (1 - |cpu - memory|)."""
    of = lambda m: F.when(_K("metric") == m, _K("value") / scale)
    aggs = [f(of(m)).cast("double").alias(f"{n}_{s}") for n, m in (("cpu", cpu), ("memory", memory)) for s, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max))]
    g = metrics.filter(_K("metric").isin(cpu, memory)).groupBy("service").agg(*aggs)
    use = (F.coalesce("cpu_mean", F.lit(0.0)) + F.coalesce("memory_mean", F.lit(0.0))) / 2
    balance = 1 - F.abs(F.coalesce("cpu_mean", F.lit(0.0)) - F.coalesce("memory_mean", F.lit(0.0)))
    return g.withColumn("use", F.when(use > 0.8, "high").when(use > 0.4, "normal").otherwise("low")).withColumn("efficiency", F.greatest(F.lit(0.0), (1 - use) * balance))


def behaviour_anomalies(current: DataFrame, baseline: DataFrame, new: int = 10) -> DataFrame:
    """service, anomaly, subject, value: what the current spans have that the baseline ones (period k >= 1, equal in length) do not.

    Volume off by half or by three std over the periods, p99 over three std, error types and operations (over ``new`` requests) never seen before.
    """
    per = baseline.groupBy("service", "k").agg(F.count("*").alias("n"), F.percentile("duration_ms", F.lit(0.99)).alias("p99"))
    base = per.groupBy("service").agg(F.avg("n").alias("mn"), F.stddev_pop("n").alias("sn"), F.avg("p99").alias("mp"), F.stddev_pop("p99").alias("sp"))
    now = current.groupBy("service").agg(F.count("*").alias("n"), F.percentile("duration_ms", F.lit(0.99)).alias("p99")).join(base, "service")
    change = percent(_K("n") - _K("mn"), _K("mn"))
    tests = [("volume_change", change, F.abs(change) > 50), ("volume", F.try_divide(_K("n") - _K("mn"), _K("sn")), F.abs(F.try_divide(_K("n") - _K("mn"), _K("sn"))) > 3), ("latency", F.try_divide(_K("p99") - _K("mp"), _K("sp")), F.try_divide(_K("p99") - _K("mp"), _K("sp")) > 3)]
    rows = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(n).alias("anomaly"), F.lit(None).cast("string").alias("subject"), v.cast("double").alias("value"))) for n, v, test in tests]))
    out = now.select("service", F.explode(rows).alias("a")).select("service", "a.*")
    for column, name, least in (("error_type", "new_error_type", 1), ("operation", "new_operation", new + 1)):
        there = current.filter(_K(column).isNotNull()).groupBy("service", _K(column).alias("subject")).agg(F.count("*").cast("double").alias("value")).filter(_K("value") >= least)
        seen = baseline.select("service", _K(column).alias("subject")).distinct()
        out = out.unionByName(there.join(seen, ["service", "subject"], "left_anti").select("service", F.lit(name).alias("anomaly"), "subject", "value"))
    return out


def behaviour_score(anomalies: DataFrame, services: DataFrame) -> DataFrame:
    """service, anomalies, score (100 less 15 each for latency and volume, 10 each for the others), grade."""
    cost = F.when(_K("anomaly").isin("latency", "volume", "volume_change"), 15).otherwise(10)
    g = anomalies.groupBy("service").agg(F.count("*").alias("anomalies"), F.sum(cost).alias("cost"))
    out = services.select("service").distinct().join(g, "service", "left").fillna(0, ["anomalies", "cost"])
    return out.select("service", "anomalies", F.greatest(F.lit(0), 100 - _K("cost")).alias("score")).withColumn("grade", grade(_K("score"), GRADES, "F"))
