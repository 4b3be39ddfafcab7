"""Failure prediction: what failed and when, the state now, early warnings, and what may fail next.

Series are aggregates per service and bucket. A service's probability of failing comes from its
own state first; it then rises with that of the services it calls, to a fixed point.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.lineage import cut_lineage
from tracelake.functions.stats import percent, ratio
from tracelake.functions.timeutil import bucket
from tracelake.operators.aggregate import with_empty_buckets

_K = F.col

#: Fixed values for each sensitivity: error %, latency increase in ms, anomaly score, factor of the probability.
SENSITIVITY = {"low": (5.0, 100.0, 0.8, 0.7), "medium": (2.0, 50.0, 0.6, 1.0), "high": (1.0, 25.0, 0.4, 1.3)}
#: Fixed values for each resource: limit in %, hours within which it is a risk, hours within which it is critical.
LIMITS = {"cpu": (80.0, 24.0, 6.0), "memory": (85.0, 24.0, 6.0), "disk": (90.0, 48.0, 12.0)}
#: A probability above this, the time frame, the hour it stands for.
HORIZONS = ((0.8, "0-2 hours", 1), (0.6, "2-6 hours", 4), (0.4, "6-12 hours", 9))
#: The last of them, and the probability above which a failure is predicted.
LATE, LEAST = ("12-24 hours", 18), 0.3


def _slope(value: str, order: Column) -> Column:
    """Slope over the mean of a value by its place, to be used in an aggregate."""
    return ratio(F.regr_slope(_K(value).cast("double"), order.cast("double")), F.avg(value))


def service_series(spans: DataFrame, seconds: int) -> DataFrame:
    """service, bucket, i (from 0), requests, errors, error_rate, latency; empty buckets between are zeros."""
    per = spans.groupBy("service", bucket(_K("start_ts"), seconds).alias("bucket")).agg(F.count("*").alias("requests"), F.count_if("is_error").alias("errors"), F.avg("duration_ms").cast("double").alias("latency"))
    rows = with_empty_buckets(per, ["service"], seconds, {"requests": 0, "errors": 0, "latency": 0.0})
    place = F.row_number().over(Window.partitionBy("service").orderBy("bucket")) - 1
    return rows.withColumn("i", place).withColumn("error_rate", percent(_K("errors"), _K("requests")))


# what has failed ------------------------------------------------------------------------


def failure_timeline(spans: DataFrame, seconds: int = 3600) -> DataFrame:
    """bucket, i, errors of all services, with empty buckets."""
    per = spans.filter("is_error").groupBy(bucket(_K("start_ts"), seconds).alias("bucket")).agg(F.count("*").alias("errors"))
    rows = with_empty_buckets(per, [], seconds, {"errors": 0})
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bucket")) - 1)  # a row a bucket


def failure_patterns(spans: DataFrame, seconds: int = 3600, per_bucket: int = 10) -> DataFrame:
    """pattern, service, strength, severity: a rising trend (> .2), bursts (> mean + 2 std), services with over ``per_bucket`` errors a bucket.

    The strength is the trend, the number of bursts, or the service's errors.
    """
    line = failure_timeline(spans, seconds)
    whole = line.agg(_slope("errors", _K("i")).alias("trend"), F.avg("errors").alias("m"), F.stddev_pop("errors").alias("s"), F.count("*").alias("buckets"))
    burst = line.crossJoin(F.broadcast(whole)).agg(F.count_if(_K("errors") > _K("m") + 2 * _K("s")).alias("bursts"))
    none = F.lit(None).cast("string").alias("service")
    rising = whole.filter(_K("trend") > 0.2).select(F.lit("increasing_failures").alias("pattern"), none, _K("trend").alias("strength"), F.when(_K("trend") > 0.5, "high").otherwise("medium").alias("severity"))
    bursts = burst.filter("bursts > 0").select(F.lit("failure_bursts").alias("pattern"), none, _K("bursts").cast("double").alias("strength"), F.lit("high").alias("severity"))
    each = spans.filter("is_error").groupBy("service").agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole.select("buckets")))
    often = each.filter(_K("n") > per_bucket * _K("buckets")).select(F.lit("service_specific").alias("pattern"), "service", _K("n").cast("double").alias("strength"), F.lit("medium").alias("severity"))
    return rising.unionByName(bursts).unionByName(often)


def failure_peaks(spans: DataFrame, hours: int = 3, days: int = 2) -> DataFrame:
    """unit (hour of day or ISO weekday), value, count of the commonest failure times; ties by value."""
    units = F.array(F.struct(F.lit("hour").alias("unit"), F.hour("start_ts").alias("value")), F.struct(F.lit("day").alias("unit"), (F.weekday("start_ts") + 1).alias("value")))
    per = spans.filter("is_error").select(F.explode(units).alias("u")).groupBy("u.unit", "u.value").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("count"), "value"))
    return per.withColumn("r", place).filter(_K("r") <= F.when(_K("unit") == "hour", hours).otherwise(days)).drop("r")


# the state now --------------------------------------------------------------------------


def service_state(spans: DataFrame, seconds: int = 600) -> DataFrame:
    """Per service: requests, error %, p95, trend of its errors (slope over mean beyond .3, three buckets at least)."""
    t = service_series(spans, seconds).groupBy("service").agg(_slope("errors", _K("i")).alias("slope"), F.count("*").alias("n"))
    g = spans.groupBy("service").agg(F.count("*").alias("requests"), percent(F.count_if("is_error"), F.count("*")).alias("error_rate"), F.percentile("duration_ms", F.lit(0.95)).alias("p95"))
    trend = F.when(_K("n") < 3, "stable").when(_K("slope") > 0.3, "increasing").when(_K("slope") < -0.3, "decreasing").otherwise("stable")
    return g.join(t, "service").select("service", "requests", "error_rate", "p95", "slope", trend.alias("trend"))


def load_state(spans: DataFrame, seconds: int = 300) -> DataFrame:
    """One row: requests a second in the last bucket, and the load's trend (spiking > .5, increasing > .2, decreasing < -.2)."""
    per = spans.groupBy(bucket(_K("start_ts"), seconds).alias("bucket")).agg(F.count("*").alias("n"))
    rows = with_empty_buckets(per, [], seconds, {"n": 0}).withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bucket")))
    g = rows.agg((F.max_by("n", "i") / seconds).alias("rate"), _slope("n", _K("i")).alias("slope"))
    return g.withColumn("trend", F.when(_K("slope") > 0.5, "spiking").when(_K("slope") > 0.2, "increasing").when(_K("slope") < -0.2, "decreasing").otherwise("stable"))


def overall_health(state: DataFrame) -> DataFrame:
    """One row: 100 less errors (mean above 1 %: 5 a percent, 30 at most), slow services (5 each, 20 at most), rising ones (10 each, 20 at most)."""
    g = state.agg(F.avg("error_rate").alias("e"), F.count_if(_K("p95") > 2000).alias("slow"), F.count_if((_K("trend") == "increasing") & (_K("error_rate") > 0.5)).alias("rising"), F.count("*").alias("n"))
    score = 100 - F.when(_K("e") > 1, F.least(F.lit(30.0), _K("e") * 5)).otherwise(0.0) - F.least(F.lit(20), _K("slow") * 5) - F.least(F.lit(20), _K("rising") * 10)
    return g.select(F.when(_K("n") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), score)).alias("health"))


# early warnings -------------------------------------------------------------------------


def warning_signals(spans: DataFrame, seconds: int = 600, sensitivity: str = "medium") -> DataFrame:
    """service, signal, severity, score, value, baseline, direction: last bucket against all but the last two, five buckets at least.

    Errors, latency and traffic are one long series each, so one pass serves all three.
    """
    errors, latency, least, _ = SENSITIVITY[sensitivity]
    kinds = [("error_rate_anomaly", "error_rate"), ("latency_anomaly", "latency"), ("traffic_anomaly", "requests")]
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), _K(c).cast("double").alias("value")) for k, c in kinds])).alias("s")
    rows = service_series(spans, seconds).withColumn("last", F.max("i").over(Window.partitionBy("service"))).filter("last >= 4").select("service", "i", "last", long).select("service", "i", "last", "s.*")
    old = _K("i") <= _K("last") - 2
    g = rows.groupBy("service", "signal").agg(F.avg(F.when(old, _K("value"))).alias("baseline"), F.stddev_pop(F.when(old, _K("value"))).alias("std"), F.max_by("value", "i").alias("value"))
    g = g.withColumn("score", F.least(F.lit(1.0), ratio(F.abs(_K("value") - _K("baseline")), _K("std")) / 3)).filter(_K("score") > least)
    more = _K("value") - _K("baseline")
    change = percent(more, _K("baseline"))
    is_error, is_latency = _K("signal") == "error_rate_anomaly", _K("signal") == "latency_anomaly"
    found = F.when(is_error, _K("value") > errors).when(is_latency, more > latency).otherwise(F.abs(change) > 50)
    high = F.when(is_error, _K("score") > 0.8).when(is_latency, more > 2 * latency).otherwise(F.abs(change) > 100)
    direction = F.when(is_error | is_latency, "increasing").when(change > 0, "spiking").otherwise("dropping")
    return g.filter(found).select("service", "signal", F.when(high, "high").otherwise("medium").alias("severity"), "score", "value", "baseline", direction.alias("direction"))


def exhaustion(metrics: DataFrame, limits: Mapping[str, tuple[float, float, float]] = LIMITS, seconds: int = 1800, ahead: float = 24.0) -> DataFrame:
    """Per resource (metric): current, projected and hours until its limit by the mean step from its first to its last positive bucket, and severity where that is a risk.

    Fewer than three positive buckets say nothing.
    """
    per = metrics.filter(_K("metric").isin(*limits)).groupBy("metric", bucket(_K("ts"), seconds).alias("bucket")).agg(F.avg("value").cast("double").alias("value")).filter("value > 0")
    g = per.groupBy("metric").agg(F.min_by("value", "bucket").alias("first"), F.max_by("value", "bucket").alias("current"), F.count("*").alias("n")).filter("n >= 3")
    of = lambda k: F.element_at(F.create_map(*[x for m, v in limits.items() for x in (F.lit(m), F.lit(v[k]))]), _K("metric"))
    step = (_K("current") - _K("first")) / (_K("n") - 1) * (3600 / seconds)
    g = g.withColumn("per_hour", step).withColumn("hours", F.when((_K("per_hour") > 0) & (_K("current") < of(0)), (of(0) - _K("current")) / _K("per_hour")))
    severity = F.when(_K("hours") < of(2), "critical").when(_K("hours") < of(1), "high")
    return g.select("metric", "current", F.least(F.lit(100.0), _K("current") + _K("per_hour") * ahead).alias("projected"), _K("hours").alias("hours_left"), severity.alias("severity"))


# what may fail next ---------------------------------------------------------------------


def _frame(probability: Column) -> tuple[Column, Column]:
    """(time frame, hour it stands for)."""
    name = hour = None
    for over, text, h in HORIZONS:
        test = probability > over
        name, hour = (F.when(test, text), F.when(test, h)) if name is None else (name.when(test, text), hour.when(test, h))
    return name.otherwise(LATE[0]), hour.otherwise(LATE[1])


def own_probability(state: DataFrame, signals: DataFrame, history: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """service, probability, signals, buckets: error rate, warnings, trend and the mean of the last six buckets with failures.

    history: service, bucket, errors (a row a bucket with failures).
    """
    place = F.row_number().over(Window.partitionBy("service").orderBy(F.desc("bucket")))
    past = history.filter("errors > 0").withColumn("r", place).groupBy("service").agg(F.avg(F.when(_K("r") <= 6, _K("errors"))).alias("recent"), F.count("*").alias("buckets"))
    warned = signals.groupBy("service").agg(F.count("*").alias("signals"), F.sum(F.when(_K("severity") == "high", 0.2).otherwise(0.1)).alias("weight"))
    e = _K("error_rate")
    p = F.when(e > 5, 0.3).when(e > 2, 0.2).when(e > 1, 0.1).otherwise(0.0) + F.coalesce("weight", F.lit(0.0)) + F.when(_K("trend") == "increasing", 0.15).otherwise(0.0) + F.when(_K("recent") > 10, 0.2).when(_K("recent") > 5, 0.1).otherwise(0.0)
    rows = state.join(warned, "service", "left").join(past, "service", "left")
    return rows.select("service", F.least(F.lit(1.0), p * SENSITIVITY[sensitivity][3]).alias("probability"), F.coalesce("signals", F.lit(0)).alias("signals"), F.coalesce("buckets", F.lit(0)).alias("buckets"))


def cascade(own: DataFrame, edges: DataFrame, reach: float = 0.5, tolerance: float = 1e-7, rounds: int = 60) -> DataFrame:
    """service, own, probability: p(s) = 1 - (1 - own(s)) * product over the services it calls of (1 - reach * share of its calls * p(callee)).

    The callees' weights of a service sum to ``reach`` at most, so rounds shrink the difference to
    the one fixed point by that factor; beyond ``rounds`` the job stops with an error. A callee
    that nothing is known of can't fail.
    """
    if not 0 <= reach < 1:
        raise ValueError("reach lies in [0, 1)")
    total = Window.partitionBy("source")
    weights = cut_lineage(edges.select(_K("source").alias("service"), _K("target").alias("callee"), (reach * _K("call_count") / F.sum("call_count").over(total)).alias("w")))
    now = cut_lineage(own.select("service", _K("probability").cast("double").alias("own"), _K("probability").cast("double").alias("probability")))
    for _ in range(rounds):
        callee = now.select(_K("service").alias("callee"), _K("probability").alias("p"))
        # the product of 1 - w p as a sum of logarithms; a certain failure never makes it zero, as w < 1
        below = weights.join(callee, "callee").groupBy("service").agg(F.exp(F.sum(F.log1p(-_K("w") * _K("p")))).alias("spared"))
        step = cut_lineage(now.join(below, "service", "left").select("service", "own", _K("probability").alias("was"), (1 - (1 - _K("own")) * F.coalesce("spared", F.lit(1.0))).alias("probability")))
        now = step.select("service", "own", "probability")
        if (step.agg(F.max(F.abs(_K("probability") - _K("was")))).first()[0] or 0.0) <= tolerance:
            return now
    raise RuntimeError(f"probabilities didn't settle in {rounds} rounds")


def predictions(own: DataFrame, spread: DataFrame, exhausted: DataFrame, patterns: DataFrame, peaks: DataFrame, hour_now: int, window: float = 24.0) -> DataFrame:
    """kind, service, detail, probability, timeframe, hour, severity, confidence of everything that may fail within ``window`` hours.

    own: own_probability(); spread: cascade(); exhausted: exhaustion(); patterns, peaks: failure_patterns(), failure_peaks().
    """
    none, text = F.lit(None).cast("string"), lambda x: F.lit(x)
    name, hour = _frame(_K("probability"))
    level = F.when(_K("probability") > 0.7, "critical").when(_K("probability") > 0.5, "high").otherwise("medium")
    sure = F.when((_K("signals") > 3) & (_K("buckets") > 20), "high").when((_K("signals") > 1) & (_K("buckets") > 10), "medium").otherwise("low")

    def rows(df: DataFrame, kind: str, service: Column, detail: Column, p: Column, frame: Column, at: Column, severity: Column, confidence: Column) -> DataFrame:
        return df.select(text(kind).alias("kind"), service.alias("service"), detail.alias("detail"), p.cast("double").alias("probability"), frame.alias("timeframe"), at.cast("double").alias("hour"), severity.alias("severity"), confidence.alias("confidence"))

    out = rows(own.filter(_K("probability") > LEAST), "service_failure", _K("service"), none, _K("probability"), name, hour, level, sure)
    fed = spread.filter((_K("probability") > LEAST) & (_K("own") <= LEAST))
    out = out.unionByName(rows(fed, "cascading_failure", _K("service"), text("callees"), _K("probability"), name, hour, level, text("medium")))
    soon = exhausted.filter(_K("severity").isNotNull() & (_K("hours_left") < window))
    hours = F.concat(F.format_number("hours_left", 1), text(" hours"))
    out = out.unionByName(rows(soon, "resource_exhaustion", none, _K("metric"), F.when(_K("hours_left") < 6, 0.9).otherwise(0.7), hours, F.floor("hours_left"), _K("severity"), text("high")))
    rising = patterns.filter((_K("pattern") == "increasing_failures") & (_K("strength") > 0.5))
    out = out.unionByName(rows(rising, "cascading_failure", none, text("trend"), text(0.6), text("6-12 hours"), text(9), text("high"), text("medium")))
    ahead = F.pmod(_K("value") - hour_now, F.lit(24))
    peak = peaks.filter((_K("unit") == "hour") & (ahead > 0) & (ahead < window))
    return out.unionByName(rows(peak, "periodic_failure", none, F.concat(_K("value").cast("string"), text(":00")), text(0.5), F.concat(ahead.cast("string"), text(" hours")), ahead, text("medium"), text("medium")))


def probability_rollup(found: DataFrame) -> DataFrame:
    """by (horizon, service, kind), name, probability (the largest), predictions."""
    horizon = F.when(_K("timeframe") == "0-2 hours", "immediate").when(_K("timeframe").isin("2-6 hours", "6-12 hours"), "short").when(_K("timeframe") == "12-24 hours", "medium")
    parts = F.array(*[F.struct(F.lit(k).alias("by"), c.alias("name")) for k, c in (("horizon", horizon), ("service", _K("service")), ("kind", _K("kind")))])
    return found.select(F.explode(parts).alias("k"), "probability").filter("k.name is not null").groupBy("k.by", "k.name").agg(F.max("probability").alias("probability"), F.count("*").alias("predictions"))


def risk_timeline(found: DataFrame, window: int = 24, step: int = 6) -> DataFrame:
    """start, probability (the largest), predictions, risk of each ``step`` hours, those without predictions too."""
    every = found.sparkSession.range(0, window, step).select(_K("id").alias("start"))
    per = found.groupBy((F.floor(_K("hour") / step) * step).alias("start")).agg(F.max("probability").alias("probability"), F.count("*").alias("predictions"))
    out = every.join(per, "start", "left").fillna(0, ["predictions"]).fillna(0.0, ["probability"])
    return out.withColumn("risk", F.when(_K("probability") > 0.7, "critical").when(_K("probability") > 0.5, "high").when(_K("probability") > 0.3, "medium").otherwise("low"))


def failure_causes(found: DataFrame, signals: DataFrame) -> DataFrame:
    """service, role (primary or contributing), cause, evidence (the worst score) of the predictions."""
    failing = found.filter("kind = 'service_failure'").select("service")
    told = signals.join(failing, "service", "left_semi").filter(_K("signal").isin("error_rate_anomaly", "latency_anomaly"))
    is_error = _K("signal") == "error_rate_anomaly"
    rows = told.select("service", F.when(is_error, "primary").otherwise("contributing").alias("role"), F.when(is_error, "Error rate anomaly").otherwise("Performance degradation").alias("cause"), _K("score").alias("evidence"))
    short = found.filter("kind = 'resource_exhaustion'").select("service", F.lit("primary").alias("role"), F.concat("detail", F.lit(" exhaustion")).alias("cause"), _K("probability").alias("evidence"))
    return rows.unionByName(short)
