"""Time-series operators: buckets, fill, smoothing, trend, seasonality, change points, forecast, correlation.

A series is rows (series, i, ts, value); windows are partitioned by series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.stats import ratio, smoothed
from tracelake.functions.timeutil import bucket
from tracelake.operators.aggregate import with_empty_buckets

Z = {0.9: 1.645, 0.95: 1.96, 0.99: 2.576}


def to_series(df: DataFrame, ts: str, value: Column, seconds: int, keys: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """keys, ts, value and the place i in each series; empty buckets get ``fill`` (None: they stay out)."""
    b = df.groupBy(*keys, bucket(F.col(ts), seconds).alias("ts")).agg(value.cast("double").alias("value"))
    if fill is not None:
        b = with_empty_buckets(b, keys, seconds, {"value": fill}, "ts")
    return b.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1)


def fill_missing(series: DataFrame, keys: Sequence[str], how: str = "interpolate") -> DataFrame:
    """Null values as zero, the previous value, or on the line between neighbours."""
    w = Window.partitionBy(*keys).orderBy("i")
    if how == "zero":
        return series.withColumn("value", F.coalesce("value", F.lit(0.0)))
    before = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if how == "previous":
        return series.withColumn("value", F.coalesce(before, F.lit(0.0)))
    after = F.first("value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    known = F.when(F.col("value").isNotNull(), F.col("i"))
    bi, ai = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    line = before + (after - before) * ratio(F.col("i") - bi, ai - bi)
    return series.withColumn("value", F.coalesce("value", line, before, after, F.lit(0.0)))


def smooth(series: DataFrame, keys: Sequence[str], method: str = "sma", window: int = 5) -> DataFrame:
    """Centred moving average over [i - w//2, i + ceil(w/2)), or exponential smoothing with 2/(w+1)."""
    w = Window.partitionBy(*keys).orderBy("i")
    if method != "ema":
        return series.withColumn("smooth", F.avg("value").over(w.rowsBetween(-(window // 2), -(-window // 2) - 1)))
    packed = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "ts", "value"))).alias("p"))
    packed = packed.withColumn("s", smoothed(F.transform("p", lambda x: x["value"]), 2 / (window + 1)))
    return packed.select(*keys, F.explode(F.arrays_zip("p", "s")).alias("z")).select(*keys, F.col("z.p.i").alias("i"), F.col("z.p.ts").alias("ts"), F.col("z.p.value").alias("value"), F.col("z.s").alias("smooth"))


def statistics(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mean, upper median, std, min, max, coefficient of variation."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy("value", "i")) - 1
    marked = series.withColumn("_m", F.when(rank == F.floor(F.count("*").over(w) / 2), F.col("value")))
    out = marked.groupBy(*keys).agg(F.avg("value").alias("mean"), F.max("_m").alias("median"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.withColumn("cv", ratio(F.col("std"), F.col("mean")))


def trend(series: DataFrame, keys: Sequence[str], x: Column | None = None, flat: float = 0.01) -> DataFrame:
    """Least squares on x (the place by default): slope, R2, change in %, direction, normalised slope."""
    x = (F.col("i") if x is None else x).cast("double")
    out = series.groupBy(*keys).agg(F.regr_slope("value", x).alias("slope"), F.regr_r2("value", x).alias("r2"), F.regr_intercept("value", x).alias("intercept"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.avg("value").alias("mean"))
    first, last = F.col("intercept") + F.col("slope") * F.col("_lo"), F.col("intercept") + F.col("slope") * F.col("_hi")
    direction = F.when(F.abs("slope") <= flat, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return out.select(*keys, "slope", F.coalesce("r2", F.lit(0.0)).alias("r2"), "intercept", (ratio(last - first, F.abs(first)) * 100).alias("change"), direction.alias("direction"), F.least(F.abs(F.coalesce("r2", F.lit(0.0))), F.lit(1.0)).alias("strength"), ratio(F.col("slope"), F.col("mean")).alias("normalised"))


def seasonality(series: DataFrame, keys: Sequence[str], periods: Sequence[int] = (24, 7, 30)) -> DataFrame:
    """Per period the largest spread of values at the same offset."""
    rows = series.withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods]))).withColumn("offset", F.col("i") % F.col("period"))
    spread = rows.groupBy(*keys, "period", "offset").agg((F.max("value") - F.min("value")).alias("s"))
    return spread.groupBy(*keys, "period").agg(F.max("s").alias("amplitude"))


def autocorrelation(series: DataFrame, keys: Sequence[str], lags: Sequence[int] = (12, 24, 48), least: float = 0.3) -> DataFrame:
    """Mean product of deviations at each lag over the variance, and whether it passes ``least``."""
    g = Window.partitionBy(*keys)
    d = series.withColumn("_d", F.col("value") - F.avg("value").over(g)).withColumn("_v", F.var_pop("value").over(g))
    out = None
    for lag in lags:
        one = d.withColumn("_l", F.lag("_d", lag).over(g.orderBy("i"))).groupBy(*keys).agg(ratio(F.avg(F.col("_d") * F.col("_l")), F.max("_v")).alias("correlation")).withColumn("lag", F.lit(lag))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("seasonal", F.col("correlation") > least)


def seasonal_adjust(series: DataFrame, keys: Sequence[str], period: int) -> DataFrame:
    """Value less the mean of its 1 % phase bin plus the grand mean."""
    phase = F.floor((F.col("i") % period) / period * 100)
    g, bins = Window.partitionBy(*keys), Window.partitionBy(*keys, phase)
    return series.withColumn("adjusted", F.col("value") - F.avg("value").over(bins) + F.avg("value").over(g))


def change_points(series: DataFrame, keys: Sequence[str], window: int | None = None) -> DataFrame:
    """Places where the mean moves by over 2 std of the frame before, or the std doubles or halves."""
    n = window or 10
    w = Window.partitionBy(*keys).orderBy("i")
    before, after = w.rowsBetween(-n, -1), w.rowsBetween(0, n - 1)
    rows = series.select("*", F.avg("value").over(before).alias("_m0"), F.stddev_pop("value").over(before).alias("_s0"), F.avg("value").over(after).alias("_m1"), F.stddev_pop("value").over(after).alias("_s1"), F.count("value").over(before).alias("_n0"), F.count("value").over(after).alias("_n1"))
    mean = F.abs(F.col("_m1") - F.col("_m0")) > 2 * F.col("_s0")
    spread = F.try_divide("_s1", "_s0")
    kind = F.when(mean, "mean").when((spread > 2) | (spread < 0.5), "variance")
    return rows.filter((F.col("_n0") == n) & (F.col("_n1") == n)).withColumn("kind", kind).filter("kind is not null").select(*keys, "i", "ts", "kind")


def forecast(series: DataFrame, keys: Sequence[str], periods: int, confidence: float = 0.95, season: int | None = None) -> DataFrame:
    """last + slope k (times a seasonal factor), with the band z s sqrt(1 + 1/n + k^2/n)."""
    model = series.groupBy(*keys).agg(F.max_by("value", "i").alias("_last"), F.coalesce(F.regr_slope("value", F.col("i").cast("double")), F.lit(0.0)).alias("_slope"), F.stddev_pop("value").alias("_std"), F.count("*").alias("_n"), F.avg("value").alias("_mean"), F.max("i").alias("_i"))
    steps = model.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    factor = F.lit(1.0)
    if season:
        offsets = series.groupBy(*keys, (F.col("i") % season).alias("_o")).agg(F.avg("value").alias("_om"))
        steps = steps.withColumn("_o", (F.col("_i") + F.col("k")) % season).join(offsets, [*keys, "_o"], "left")
        factor = F.coalesce(F.try_divide("_om", "_mean"), F.lit(1.0))
    value = (F.col("_last") + F.col("_slope") * F.col("k")) * factor
    band = Z[confidence] * F.col("_std") * F.sqrt(1 + 1 / F.col("_n") + F.col("k") * F.col("k") / F.col("_n"))
    return steps.select(*keys, "k", value.alias("forecast"), (value - band).alias("lower"), (value + band).alias("upper"))


def candidates(series: DataFrame, keys: Sequence[str], periods: int, alpha: float = 0.3) -> DataFrame:
    """Forecasts by moving average of min(5, n/4), by linear drift and by exponential smoothing."""
    w = Window.partitionBy(*keys)
    last = series.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.col("_n") / 4))))
    sma = last.filter(F.col("i") >= F.col("_n") - F.col("_k")).groupBy(*keys).agg(F.avg("value").alias("sma"))
    base = series.groupBy(*keys).agg(F.min_by("value", "i").alias("_a"), F.max_by("value", "i").alias("_z"), F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct("i", "value"))).alias("_p"))
    base = base.withColumn("ses", F.element_at(smoothed(F.transform("_p", lambda x: x["value"]), alpha), -1)).withColumn("_drift", ratio(F.col("_z") - F.col("_a"), F.col("_n") - 1)).join(sma, list(keys))
    return base.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(periods)))).select(*keys, "k", "sma", (F.col("_z") + F.col("_drift") * F.col("k")).alias("drift"), "ses")


def choose_forecast(series: DataFrame, keys: Sequence[str], periods: int, share: float = 0.2) -> DataFrame:
    """The candidate with the least mean absolute percentage error on the last part, with MAPE, RMSE and its forecast band (never below 0)."""
    n = F.count("*").over(Window.partitionBy(*keys))
    cut = series.withColumn("_c", F.greatest(F.lit(1), F.floor(n * (1 - share))))
    train, test = cut.filter(F.col("i") < F.col("_c")), cut.filter(F.col("i") >= F.col("_c")).withColumn("k", (F.col("i") - F.col("_c") + 1).cast("int"))
    ahead = test.agg(F.max("k")).first()[0] or 1
    long = lambda df: df.unpivot([*keys, "k"], ["sma", "drift", "ses"], "method", "forecast")
    scored = test.select(*keys, "k", "value").join(long(candidates(train.drop("_c"), keys, ahead)), [*keys, "k"])
    err = F.col("forecast") - F.col("value")
    score = scored.groupBy(*keys, "method").agg(F.avg(F.abs(F.try_divide(err, F.col("value"))) * 100).alias("mape"), F.sqrt(F.avg(err * err)).alias("rmse"))
    best = score.groupBy(*keys).agg(F.min(F.struct(F.coalesce("mape", F.lit(1e18)).alias("m"), "method", "rmse")).alias("b")).select(*keys, F.col("b.method").alias("method"), F.col("b.m").alias("mape"), F.col("b.rmse").alias("rmse"))
    spread = series.groupBy(*keys).agg(F.stddev_pop("value").alias("_s"))
    out = long(candidates(series, keys, periods)).join(best, [*keys, "method"]).join(spread, list(keys))
    return out.select(*keys, "method", "mape", "rmse", "k", "forecast", F.greatest(F.lit(0.0), F.col("forecast") - 1.96 * F.col("_s")).alias("lower"), (F.col("forecast") + 1.96 * F.col("_s")).alias("upper"))


def forecast_summary(series: DataFrame, fc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change against the last value in %, its class, and volatility from the relative band."""
    last = series.groupBy(*keys).agg(F.max_by("value", "i").alias("_last"))
    end = fc.groupBy(*keys).agg(F.max_by("forecast", "k").alias("_end"), F.avg(ratio(F.col("upper") - F.col("lower"), F.col("forecast"))).alias("_band"))
    change = ratio(F.col("_end") - F.col("_last"), F.col("_last")) * 100
    kind = F.when(F.abs(change) < 1, "stable").when(change > 10, "sharp increase").when(change > 0, "increase").when(change < -10, "sharp decrease").otherwise("decrease")
    return last.join(end, list(keys)).select(*keys, change.alias("change"), kind.alias("kind"), F.when(F.col("_band") < 0.05, "low").when(F.col("_band") < 0.15, "medium").otherwise("high").alias("volatility"))


def correlations(series: DataFrame, name: str, ts: str = "ts", least: float = 0.7) -> DataFrame:
    """Pearson correlation of all pairs on their common timestamps."""
    a = series.select(ts, F.col(name).alias("a"), F.col("value").alias("x"))
    b = series.select(ts, F.col(name).alias("b"), F.col("value").alias("y"))
    out = a.join(b, ts).filter("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("correlation"), F.count("*").alias("n"))
    size = F.abs("correlation")
    strength = F.when(size >= 0.9, "very strong").when(size >= 0.7, "strong").when(size >= 0.5, "moderate").otherwise("weak")
    return out.filter(size >= least).withColumn("direction", F.when(F.col("correlation") > 0, "positive").otherwise("negative")).withColumn("strength", strength)


def cross_correlation(series: DataFrame, name: str, most: int = 20, least: float = 0.5) -> DataFrame:
    """Per pair the lag within ±min(most, n/4) of the largest absolute correlation, and who leads."""
    n = series.groupBy(name).agg(F.count("*").alias("_n"))
    lags = F.least(F.lit(most), F.floor(F.col("_n") / 4)).cast("int")
    a = series.join(F.broadcast(n), name).select(F.col(name).alias("a"), F.col("i"), F.col("value").alias("x"), F.explode(F.sequence(-lags, lags)).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    b = series.select(F.col(name).alias("b"), F.col("i").alias("j"), F.col("value").alias("y"))
    c = a.join(b, "j").filter("a < b").groupBy("a", "b", "lag").agg(F.corr("x", "y").alias("c"))
    best = c.groupBy("a", "b").agg(F.max(F.struct(F.abs("c").alias("s"), -F.abs("lag"), "lag", "c")).alias("m")).select("a", "b", F.col("m.lag").alias("lag"), F.col("m.c").alias("correlation"))
    leads = F.when((F.abs("correlation") >= least) & (F.col("lag") > 0), F.col("a")).when((F.abs("correlation") >= least) & (F.col("lag") < 0), F.col("b"))
    return best.withColumn("leader", leads)


def similarity(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairwise likeness: mean of slope and variation likeness."""
    s = trend(series, keys).select(*keys, "slope").join(statistics(series, keys).select(*keys, "cv"), list(keys))
    name = keys[0]
    a, b = s.select(F.col(name).alias("a"), F.col("slope").alias("sa"), F.col("cv").alias("ca")), s.select(F.col(name).alias("b"), F.col("slope").alias("sb"), F.col("cv").alias("cb"))
    like = lambda x, y: 1 - ratio(F.abs(F.col(x) - F.col(y)), F.greatest(F.abs(x), F.abs(y)))
    return a.crossJoin(b).filter("a < b").select("a", "b", ((like("sa", "sb") + like("ca", "cb")) / 2).alias("similarity"))


def resource_trend(series: DataFrame, keys: Sequence[str], threshold: float, per_hour: int = 2, horizon_h: int = 24) -> DataFrame:
    """Current value, projection, hours to the threshold and whether that is within the horizon."""
    m = series.groupBy(*keys).agg(F.max_by("value", "i").alias("current"), F.regr_slope("value", F.col("i").cast("double")).alias("slope"))
    hours = F.when(F.col("current") >= threshold, 0.0).when(F.col("slope") > 0, (threshold - F.col("current")) / (F.col("slope") * per_hour))
    return m.select(*keys, "current", (F.col("current") + F.col("slope") * per_hour * horizon_h).alias("projected"), hours.alias("hours"), F.coalesce(hours < horizon_h, F.lit(False)).alias("at_risk"))


def compare_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """Volume change in %, trends, positional correlation."""
    ta, tb = (trend(x.withColumn("_k", F.lit(1)), ["_k"], flat=0.1) for x in (a, b))
    vol = a.agg(F.sum("value").alias("va")).crossJoin(b.agg(F.sum("value").alias("vb")))
    cor = a.select("i", F.col("value").alias("x")).join(b.select("i", F.col("value").alias("y")), "i").agg(F.corr("x", "y").alias("correlation"))
    same = F.when(F.col("da") == F.col("db"), "same").when((F.col("da") != "stable") & (F.col("db") != "stable"), "reversed").otherwise("changed")
    return vol.crossJoin(cor).crossJoin(ta.select(F.col("direction").alias("da"))).crossJoin(tb.select(F.col("direction").alias("db"))).select((ratio(F.col("va") - F.col("vb"), F.col("vb")) * 100).alias("volume_change"), "correlation", same.alias("trend"))
