"""Performance regressions against shifted baseline periods: what got worse, how it came about, why, and what it means.

Everything is per service; a regression is a row, so reports are groups of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.stats import percent, ratio
from tracelake.functions.timeutil import bucket

_K = F.col
#: Percentiles that are watched, with the weight of their deviation.
WATCHED = {"p50": (0.5, 1.0), "p95": (0.95, 1.2), "p99": (0.99, 1.5)}


def period_measures(spans: DataFrame, start: str, end: str, periods: int = 7, step_days: int = 1) -> DataFrame:
    """Per service, operation (null: the whole service) and period k (0: current): requests, percentiles, success rate. One scan, periods exploded."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    k = F.explode(F.sequence(F.lit(0), F.lit(periods))).alias("k")
    shifted = lambda c: c - F.make_dt_interval(_K("k") * step_days)
    rows = spans.filter((_K("start_ts") >= lo - F.make_dt_interval(F.lit(periods * step_days))) & (_K("start_ts") < hi)).select("service", "operation", "start_ts", "duration_ms", "is_error", k)
    rows = rows.filter((_K("start_ts") >= shifted(lo)) & (_K("start_ts") < shifted(hi)))
    rows = rows.withColumn("operation", F.explode(F.array("operation", F.lit(None).cast("string"))))
    success = (100 - percent(F.count_if("is_error"), F.count("*"))).alias("success")
    return rows.groupBy("service", "operation", "k").agg(F.count("*").alias("requests"), *[F.percentile("duration_ms", F.lit(p)).alias(n) for n, (p, _) in WATCHED.items()], success)


def latency_severity(z: Column, weight: Column) -> Column:
    w = z * weight
    return F.when(w > 5, "critical").when(w > 3.5, "high").when(w > 2.5, "medium").otherwise("low")


def success_severity(now: Column, drop: Column) -> Column:
    return F.when((now < 95) | (drop > 5), "critical").when((now < 98) | (drop > 2), "high").when((now < 99) | (drop > 1), "medium").otherwise("low")


def regressions(measures: DataFrame, t: float = 2.5) -> DataFrame:
    """A row per regression: percentiles over ``t`` std above their baseline, success rates below 99 % and ``t`` std under theirs.

    current, baseline (mean), z, change in % and severity, from ``period_measures``.
    """
    long = measures.unpivot(["service", "operation", "k"], [*WATCHED, "success"], "metric", "value")
    base = long.filter("k > 0").groupBy("service", "operation", "metric").agg(F.avg("value").alias("baseline"), F.stddev_pop("value").alias("std"))
    same = [_K("a.service") == _K("b.service"), _K("a.operation").eqNullSafe(_K("b.operation")), _K("a.metric") == _K("b.metric")]
    j = long.filter("k = 0").alias("a").join(base.alias("b"), same[0] & same[1] & same[2]).select("a.service", "a.operation", "a.metric", _K("value").alias("current"), "baseline", "std")
    z = F.try_divide(_K("current") - _K("baseline"), _K("std"))
    weight = F.lit(1.0)
    for name, (_, w) in WATCHED.items():
        weight = F.when(_K("metric") == name, w).otherwise(weight)
    is_success = _K("metric") == "success"
    j = j.withColumn("z", F.when(is_success, -z).otherwise(z)).filter((_K("z") > t) & (~is_success | (_K("current") < 99)))
    severity = F.when(is_success, success_severity(_K("current"), _K("baseline") - _K("current"))).otherwise(latency_severity(_K("z"), weight))
    return j.select("service", "operation", "metric", "current", "baseline", "z", percent(_K("current") - _K("baseline"), _K("baseline")).alias("change"), severity.alias("severity"))


def latency_course(spans: DataFrame, seconds: int = 60) -> DataFrame:
    """Per service: the largest step of p95 from bucket to bucket (over 2: a sudden spike) and its trend (rising with R2 over 0.5: gradual)."""
    per = spans.groupBy("service", bucket(_K("start_ts"), seconds).alias("b")).agg(F.percentile("duration_ms", F.lit(0.95)).alias("p95"))
    w = Window.partitionBy("service").orderBy("b")
    rows = per.withColumn("step", F.try_divide("p95", F.lag("p95").over(w))).withColumn("i", F.row_number().over(w).cast("double"))
    g = rows.groupBy("service").agg(F.max("step").alias("step"), F.regr_slope("p95", "i").alias("slope"), F.regr_r2("p95", "i").alias("r2"))
    return g.select("service", "step", F.coalesce(_K("step") > 2, F.lit(False)).alias("sudden"), "slope", "r2", F.coalesce((_K("slope") > 0) & (_K("r2") > 0.5), F.lit(False)).alias("gradual"))


def patterns(found: DataFrame) -> DataFrame:
    """Per service: operations hit, those hit twice or more, whether it is widespread (over three), and how much of it lies in operations."""
    per = found.groupBy("service", "operation").agg(F.count("*").alias("n"))
    own = _K("operation").isNotNull()
    g = per.groupBy("service").agg(F.count_if(own).alias("operations"), F.count_if(own & (_K("n") >= 2)).alias("concentrated"), F.sum(F.when(own, _K("n")).otherwise(0)).alias("_own"), F.sum("n").alias("_all"))
    return g.select("service", "operations", "concentrated", (_K("operations") > 3).alias("widespread"), percent(_K("_own"), _K("_all")).alias("in_operations"))


def causes(spans: DataFrame, metrics: DataFrame, found: DataFrame, seconds: int = 300, cpu: str = "cpu", most_cpu: float = 0.8) -> DataFrame:
    """Likely causes by service: traffic spikes, a busy CPU, external operations, data growth (latency doubled)."""
    per = spans.groupBy("service", bucket(_K("start_ts"), seconds).alias("b")).agg(F.count("*").alias("n"))
    traffic = per.groupBy("service").agg(F.max("n").alias("m"), F.avg("n").alias("a")).filter(_K("m") > 2 * _K("a")).select("service", F.lit("traffic_spike").alias("cause"), F.lit("high").alias("confidence"))
    busy = metrics.filter(_K("metric") == cpu).groupBy("service").agg(F.max("value").alias("m")).filter(_K("m") > most_cpu).select("service", F.lit("resource_constraint").alias("cause"), F.lit("high").alias("confidence"))
    outside = found.filter(F.contains("operation", F.lit("external"))).select("service", F.lit("dependency_degradation").alias("cause"), F.lit("medium").alias("confidence")).distinct()
    growth = found.filter((_K("metric") != "success") & (_K("change") > 100)).select("service", F.lit("data_growth").alias("cause"), F.lit("low").alias("confidence")).distinct()
    return traffic.unionByName(busy).unionByName(outside).unionByName(growth)


def impact(found: DataFrame) -> DataFrame:
    """Per service: regressions by severity, overall severity, impact score (100 / 75 / 50), SLA risk, cascading risk, scalability and urgency."""
    latency = _K("metric") != "success"
    high = _K("metric").isin("p95", "p99")
    n = lambda test: F.count_if(test)
    g = found.groupBy("service").agg(
        F.count("*").alias("regressions"), n(_K("severity") == "critical").alias("critical"), n(_K("severity") == "high").alias("high"), n(latency).alias("_latency"), n(~latency).alias("_success"),
        n(high & (_K("severity") == "critical")).alias("_hc"), n(high & (_K("severity") == "high")).alias("_hh"), n(latency & (_K("change") > 200)).alias("_far"),
    )
    score = F.when(_K("_hc") > 0, 100).when(_K("_hh") > 0, 75).when(_K("_latency") > 3, 50).otherwise(0)
    overall = F.when(_K("critical") > 0, "critical").when(_K("high") > 2, "high").when((_K("high") > 0) | (_K("regressions") > 5), "medium").otherwise("low")
    urgency = F.when((score > 75) | (_K("critical") > 0), "immediate").when((score > 50) | (_K("high") > 0), "urgent").when(score > 25, "planned").otherwise("low")
    return g.select(
        "service", "regressions", "critical", "high", overall.alias("severity"), score.alias("impact"), ((_K("_success") > 0) | (score > 75)).alias("sla_risk"),
        F.when(_K("regressions") > 5, "high").when(_K("regressions") > 2, "medium").otherwise("low").alias("cascading_risk"), (_K("_far") > 0).alias("scalability"), urgency.alias("urgency"),
    )


# dependencies -------------------------------------------------------------------------------


def dependency_risks(edges: DataFrame, health: DataFrame, direct_of: str | None = None) -> DataFrame:
    """Per dependency: percentiles, risk score, level and factors, and how critical it is.

    edges: target, call_count; health: service, error_rate, p50, p95, p99, availability, score,
    status. With ``direct_of``, dependencies are those of one service: direct ones at depth 1.
    """
    if direct_of is None:
        depth = edges.groupBy(_K("target").alias("service")).agg(F.sum("call_count").alias("calls")).withColumn("depth", F.lit(1))
    else:
        from tracelake.operators.graph import transitive

        calls = edges.groupBy(_K("target").alias("service")).agg(F.sum("call_count").alias("calls"))
        depth = transitive(edges, direct_of, 5).select("service", "depth").join(calls, "service")
    direct = _K("depth") == 1
    j = depth.join(health.drop("calls", "risk"), "service")
    rules = [
        (_K("error_rate") > 10, 30, "High error rate"), ((_K("error_rate") > 5) & (_K("error_rate") <= 10), 15, "Elevated error rate"), (_K("p95") > 2000, 20, "High latency"), ((_K("p95") > 1000) & (_K("p95") <= 2000), 10, "Moderate latency"),
        (_K("availability") < 95, 30, "Low availability"), ((_K("availability") >= 95) & (_K("availability") < 99), 15, "Suboptimal availability"), (direct & (_K("calls") > 1000), 10, "High-volume direct dependency"), (~direct & (_K("depth") > 2), 15, "Deep transitive dependency"),
    ]
    score = sum((F.when(test, points).otherwise(0) for test, points, _ in rules), F.lit(0))
    level = F.when(_K("risk_score") > 50, "high").when(_K("risk_score") > 25, "medium").otherwise("low")
    out = j.withColumn("risk_score", score).withColumn("risk", level).withColumn("factors", F.array_join(F.array_compact(F.array(*[F.when(test, name) for test, _, name in rules])), ", "))
    critical = (
        F.when((_K("risk") == "high") & (_K("calls") > 1000), "critical").when(direct & (_K("calls") > 5000) & (_K("score") < 70), "critical")
        .when((_K("status") == "unhealthy") & (_K("calls") > 500), "high").when(~direct & (_K("depth") > 2) & (_K("score") < 80), "medium").otherwise("low")
    )
    return out.withColumn("criticality", critical)


def risk_distribution(risks: DataFrame) -> DataFrame:
    """How many dependencies have each level of risk, with their mean score."""
    return risks.groupBy("risk").agg(F.count("*").alias("dependencies"), F.avg("risk_score").alias("mean_score"))


# canary -------------------------------------------------------------------------------------


def throughput_test(spans: DataFrame, canary: str, baseline: str, seconds: int = 60) -> DataFrame:
    """Welch statistics on the requests a bucket of two services: means, change in %, t, p, and the points that a significant loss costs (10 at most)."""
    from tracelake.functions.stats import step_p_value, welch

    per = spans.filter(_K("service").isin(canary, baseline)).groupBy("service", bucket(_K("start_ts"), seconds).alias("b")).agg(F.count("*").cast("double").alias("n"))
    side = lambda name, p: per.filter(_K("service") == name).agg(F.avg("n").alias(f"m{p}"), F.var_samp("n").alias(f"v{p}"), F.count("*").alias(f"n{p}"))
    j = side(canary, 1).crossJoin(side(baseline, 2))  # a row each
    t, _, _ = welch(_K("m1"), _K("v1"), _K("n1"), _K("m2"), _K("v2"), _K("n2"))
    out = j.select(_K("m1").alias("canary"), _K("m2").alias("baseline"), percent(_K("m1") - _K("m2"), _K("m2")).alias("change"), t.alias("t"), step_p_value(t).alias("p"))
    lost = F.when((_K("p") <= 0.05) & (_K("change") < -10), F.least(F.lit(10.0), F.abs("change") * 0.2)).otherwise(0.0)
    return out.withColumn("penalty", lost).withColumn("risk", F.when(_K("change") < -20, "throughput reduction"))


def path_gaps(paths: DataFrame) -> DataFrame:
    """Hops of critical paths: what the caller adds to the callee, by pair of services: mean, p95, frequency, score and a saving of half of it."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("services") - 1), lambda i: F.struct(F.element_at("services", i).alias("source"), F.element_at("services", i + 1).alias("target"), F.greatest(F.lit(0.0), F.element_at("durations", i) - F.element_at("durations", i + 1)).alias("gap")))
    rows = paths.filter(F.size("services") > 1).select(F.explode(pairs).alias("h")).select("h.*")
    g = rows.groupBy("source", "target").agg(F.avg("gap").alias("avg"), F.percentile("gap", F.lit(0.95)).alias("p95"), F.count("*").alias("frequency"))
    return g.withColumn("score", (_K("avg") * 0.5 + _K("p95") * 0.3) * F.log(_K("frequency") + 1)).withColumn("saving_ms", ratio(_K("avg"), F.lit(2.0)))
