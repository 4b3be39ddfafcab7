"""Joins by time and by trace: surrounding logs, nearest buckets, aligned series, correlated signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_context(hits: DataFrame, logs: DataFrame, key: str, k: int = 3, window_s: int = 60) -> DataFrame:
    """(hit, near, side): up to k logs before and after each hit, of its service, within the window.

    A service's logs are counted at each moment and the moments dealt by cells of one window, so
    that no service meets in one task. A hit reads, in its cell and the two beside it, only what
    may be near: the k first ids of a moment, and of the moments those that hold k logs on either
    side. Logs of the hit's own moment count as after it.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = window_s * 1_000_000
    cell = F.floor(F.col("_t") / span)
    # at most k + 1 ids of a moment can be near: one of them may be the hit itself
    moment = Window.partitionBy("service", "_t").orderBy("near")
    rows = logs.select(F.col(key).alias("near"), "service", micros("ts").alias("_t")).filter("service is not null and _t is not null and near is not null")
    few = rows.withColumn("_i", F.row_number().over(moment)).filter(F.col("_i") <= k + 1)
    moments = few.groupBy("service", "_t").agg(F.sort_array(F.collect_list("near")).alias("_ids"))
    found = hits.select(F.col(key).alias("hit"), "service", micros("ts").alias("_t")).filter("service is not null and _t is not null and hit is not null")
    asked = found.select("service", "_t").distinct()
    points = moments.join(asked.withColumn("_asked", F.lit(True)), ["service", "_t"], "left")
    # every moment stands in its own cell, and for the neighbours' sake in the two beside it
    near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.struct((cell + d).alias("cell"), (d == 0).alias("own")))
    points = points.withColumn("_c", F.explode(near)).select("service", "_t", "_ids", F.col("_c.cell").alias("_cell"), (F.col("_c.own") & F.col("_asked").isNotNull()).alias("_asks"))
    line = Window.partitionBy("service", "_cell").orderBy("_t")
    here = F.struct("_t", "_ids")
    earlier = F.collect_list(here).over(line.rowsBetween(-k, -1))
    later = F.collect_list(here).over(line.rowsBetween(0, k + 1))
    beside = points.withColumns({"_earlier": earlier, "_later": later}).filter("_asks").select("service", "_t", "_earlier", "_later")
    pairs = found.join(beside, ["service", "_t"])

    def nearest_of(side: str, name: str) -> Column:
        ids = F.flatten(F.transform(side, lambda m: F.transform(m["_ids"], lambda x: F.struct(F.abs(m["_t"] - F.col("_t")).alias("gap"), x.alias("near")))))
        within = F.filter(ids, lambda x: (x["gap"] <= span) & (x["near"] != F.col("hit")))
        return F.transform(F.slice(F.sort_array(within), 1, k), lambda x: F.struct(x["near"].alias("near"), F.lit(name).alias("side")))

    out = pairs.withColumn("_n", F.explode(F.concat(nearest_of("_earlier", "before"), nearest_of("_later", "after"))))
    return out.select("hit", F.col("_n.near").alias("near"), F.col("_n.side").alias("side"))


def nearest(left: DataFrame, right: DataFrame, lts: str, rts: str, seconds: int) -> DataFrame:
    """Each left row with the first right row closer than ``seconds``."""
    cell = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    a = left.withColumn("_cell", F.explode(F.array(cell(lts) - 1, cell(lts), cell(lts) + 1)))
    b = right.withColumn("_cell", cell(rts))
    gap = F.abs(F.unix_micros(F.col(lts).cast("timestamp")) - F.unix_micros(F.col(rts).cast("timestamp")))
    pairs = a.join(b, "_cell").filter(gap < seconds * 1_000_000)
    first = Window.partitionBy(lts, *[c for c in left.columns if c != lts]).orderBy(rts)
    return pairs.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "_cell")


def align_series(series: DataFrame, name: str, ts: str) -> DataFrame:
    """Only the timestamps at which every series has a point."""
    names = F.broadcast(series.agg(F.count_distinct(name).alias("_all")))
    full = series.groupBy(ts).agg(F.count_distinct(name).alias("_n")).crossJoin(names).filter("_n = _all").select(ts)
    return series.join(full, ts, "left_semi")


def logs_of_traces(traces: DataFrame, logs: DataFrame) -> DataFrame:
    return traces.select("trace_id").distinct().join(logs, "trace_id")


def metrics_of_services(bounds: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metric points of a service between its first_ts and last_ts."""
    return bounds.join(metrics, "service").filter((F.col("ts") >= F.col("first_ts")) & (F.col("ts") <= F.col("last_ts")))
