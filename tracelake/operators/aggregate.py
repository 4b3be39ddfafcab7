"""Grouping operators: buckets with empty ones, histograms, significant terms, top-k, comparison joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.stats import ratio
from tracelake.functions.timeutil import auto_interval, bucket


def top_terms(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n commonest values; ties by value."""
    return df.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key).limit(n)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).filter(F.col("rank") <= n)


def date_histogram(df: DataFrame, ts: str, seconds: int, keys: Sequence[str] = (), aggs: Sequence[Column] = ()) -> DataFrame:
    return df.groupBy(*keys, bucket(F.col(ts), seconds).alias("bucket")).agg(*(aggs or [F.count("*").alias("count")]))


def auto_date_histogram(df: DataFrame, ts: str, most: int = 100, aggs: Sequence[Column] = ()) -> DataFrame:
    """interval (seconds) and bucket with the smallest usual width that needs ``most`` buckets at most; only the table's bounds come to the driver."""
    first, last = df.agg(F.min(ts), F.max(ts)).first()
    width = auto_interval((last - first).total_seconds() if first is not None else 0, most - 1)  # the bounds may lie in one bucket more
    return date_histogram(df, ts, width, (), aggs).withColumn("interval", F.lit(width))


def running_mean(buckets: DataFrame, keys: Sequence[str], order: str, total: str, count: str) -> DataFrame:
    """Adds mean: what is known of a key up to each of its rows, from sums and counts that new rows only add to."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return buckets.withColumn("mean", ratio(F.sum(total).over(w), F.sum(count).over(w)))


def baseline_stats(periods: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, measure, mean, std, min, max, periods of each value over the periods of a baseline."""
    long = F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values])).alias("v")
    v = F.col("value")
    return periods.select(*keys, long).select(*keys, "v.*").groupBy(*keys, "measure").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("periods"))


def spine(buckets: DataFrame, keys: Sequence[str], seconds: int, ts: str = "bucket") -> DataFrame:
    """Every bucket of each series between its first and last one."""
    ends = buckets.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    return ends.select(*keys, F.explode(F.sequence("_lo", "_hi", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))).alias(ts))


def with_empty_buckets(buckets: DataFrame, keys: Sequence[str], seconds: int, fill: dict[str, float], ts: str = "bucket") -> DataFrame:
    return spine(buckets, keys, seconds, ts).join(buckets, [*keys, ts], "left").fillna(fill)


def numeric_histogram(df: DataFrame, value: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    key = (F.floor(F.col(value) / width) * width).cast("double").alias("key")
    return df.groupBy(*keys, key).agg(F.count("*").alias("count"))


def histogram_width(name: Column) -> Column:
    """Bucket width by the metric's name: shares 0.05, times 10, sizes 1 MiB, else 1."""
    return F.when(name.rlike("pct|percent|ratio"), 0.05).when(name.rlike("duration|latency|time"), 10.0).when(name.rlike("bytes|size|memory"), 1048576.0).otherwise(1.0)


def significant_terms(df: DataFrame, key: str, subset: Column, n: int = 10) -> DataFrame:
    """Values over-represented in a subset: (fg - bg) * fg / bg of their shares, where fg > bg."""
    per = df.groupBy(key).agg(F.count_if(subset).alias("fg"), F.count("*").alias("bg"))
    total = df.agg(F.count_if(subset).alias("fg_all"), F.count("*").alias("bg_all"))
    out = per.crossJoin(F.broadcast(total)).withColumn("fs", ratio(F.col("fg"), F.col("fg_all"))).withColumn("bs", ratio(F.col("bg"), F.col("bg_all")))
    out = out.filter(F.col("fs") > F.col("bs")).withColumn("score", (F.col("fs") - F.col("bs")) * ratio(F.col("fs"), F.col("bs")))
    return out.select(key, "fg", "bg", "score").orderBy(F.desc("score"), key).limit(n)


def compare_periods(current: DataFrame, baseline: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer comparison: state new / removed / both, and both sides' values."""
    a = current.select(*keys, *(F.col(v).alias(f"current_{v}") for v in values), F.lit(True).alias("_a"))
    b = baseline.select(*keys, *(F.col(v).alias(f"baseline_{v}") for v in values), F.lit(True).alias("_b"))
    out = a.join(b, list(keys), "full_outer")
    return out.withColumn("state", F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "removed").otherwise("both")).drop("_a", "_b")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1).drop("rank")


def rare(df: DataFrame, key: str, share: float, least: int = 2) -> DataFrame:
    """Values below a share of all rows that still occur ``least`` times."""
    per = df.groupBy(key).agg(F.count("*").alias("count"))
    total = F.broadcast(df.agg(F.count("*").alias("total")))
    return per.crossJoin(total).filter((F.col("count") >= least) & (F.col("count") < F.col("total") * share)).select(key, "count", ratio(F.col("count"), F.col("total")).alias("share"))


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Runs of consecutive flagged rows: first, last, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_f", flag).withColumn("_r", F.row_number().over(w))
    runs = rows.filter("_f").withColumn("_g", F.col("_r") - F.row_number().over(w))
    return runs.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_g")


def cumulative(df: DataFrame, keys: Sequence[str], order: str, value: str, lag: int = 1, frame: int = 5) -> DataFrame:
    """cumulative_sum, derivative, moving_avg (trailing frame with the row itself) and serial_diff."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = F.col(value)
    return df.select(
        "*", F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_sum"), (v - F.lag(v).over(w)).alias("derivative"),
        F.avg(v).over(w.rowsBetween(-(frame - 1), 0)).alias("moving_avg"), (v - F.lag(v, lag).over(w)).alias("serial_diff"),
    )


def place_of(key: Column, seed: int = 0) -> Column:
    """0 to 9999 by a hash of the key, the same on every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % 10_000


def sample_rows(df: DataFrame, percent: float, key: Column, seed: int = 0) -> DataFrame:
    """Hash sample: the same rows whatever the partitioning."""
    return df.filter(place_of(key, seed) < int(percent * 100))


def severity_sample(df: DataFrame, level: str, key: Column, fractions: dict[str, float], otherwise: float, seed: int = 0) -> DataFrame:
    """Hash sample with a fraction for each level."""
    share = F.lit(otherwise)
    for k, v in fractions.items():
        share = F.when(F.lower(level) == k, v).otherwise(share)
    return df.filter(place_of(key, seed) < share * 10_000)


def stratified_sample(df: DataFrame, group: str, percent: float, most: int, key: Column, seed: int = 0) -> DataFrame:
    """min(ceil(percent of all), most) rows, dealt by group share, at least one a group."""
    total = df.count()
    n = min(-(-int(total * percent) // 100), most)
    per = df.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(n / max(total, 1)))).alias("_n"))
    order = Window.partitionBy(group).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.join(per, group).withColumn("_r", F.row_number().over(order)).filter("_r <= _n").drop("_r", "_n")


def sampled_counts(df: DataFrame, key: str, percent: float, row_key: Column, seed: int = 0) -> DataFrame:
    """Counts of a sample and what they stand for."""
    return sample_rows(df, percent, row_key, seed).groupBy(key).agg(F.count("*").alias("sampled"), F.round(F.count("*") * 100 / percent).cast("long").alias("estimate"))
