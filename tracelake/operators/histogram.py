"""Histogram operators on rows (hist, key, count)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.stats import ratio

_K = F.col


def histogram_stats(h: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted mean, mode, std, adjusted skewness, excess kurtosis and percentiles; rows are never expanded."""
    m = h.groupBy(*keys).agg(F.sum("count").alias("n"), ratio(F.sum(_K("key") * _K("count")), F.sum("count")).alias("mean"))
    d = h.join(m, list(keys)).withColumn("_d", _K("key") - _K("mean"))
    power = lambda p: ratio(F.sum(F.pow("_d", F.lit(float(p))) * _K("count")), F.sum("count"))
    out = d.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.sqrt(power(2)).alias("std"), power(3).alias("_m3"), power(4).alias("_m4"), F.max_by("key", F.struct("count", -_K("key"))).alias("mode"),
        *[F.percentile("key", F.lit(p), _K("count")).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.95, 0.99)],
    )
    n = _K("n")
    skew = ratio(F.sqrt(n * (n - 1)), n - 2) * ratio(_K("_m3"), F.pow("std", F.lit(3.0)))
    return out.withColumn("skewness", skew).withColumn("kurtosis", ratio(_K("_m4"), F.pow("std", F.lit(4.0))) - 3).drop("_m3", "_m4")


def density(h: DataFrame, keys: Sequence[str], points: int = 100, kernel: str = "gaussian") -> DataFrame:
    """Kernel density on an even grid; bandwidth 0.9 min(std, IQR/1.34) n^-0.2; needs five buckets."""
    s = histogram_stats(h, keys)
    ends = h.groupBy(*keys).agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"), F.count("*").alias("_b")).filter("_b >= 5")
    width = 0.9 * F.least(_K("std"), F.when(_K("p75") > _K("p25"), (_K("p75") - _K("p25")) / 1.34).otherwise(_K("std"))) * F.pow("n", F.lit(-0.2))
    grid = s.join(ends, list(keys)).withColumn("_h", width).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", _K("_lo") + (_K("_hi") - _K("_lo")) * _K("k") / (points - 1))
    u = (_K("x") - _K("key")) / _K("_h")
    value = {"gaussian": F.exp(-u * u / 2) / 2.5066282746310002, "epanechnikov": F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0), "uniform": F.when(F.abs(u) <= 1, 0.5).otherwise(0.0)}[kernel]
    return grid.select(*keys, "k", "x", "_h", "n").join(h, list(keys)).groupBy(*keys, "k", "x").agg(F.sum(value * _K("count") / (_K("n") * _K("_h"))).alias("density"))


def divergences(p: DataFrame, q: DataFrame) -> DataFrame:
    """KL and JS (terms with a zero skipped), Wasserstein as the mean CDF gap, Bhattacharyya; one row."""
    a = p.select("key", (_K("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))).alias("p"))
    b = q.select("key", (_K("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))).alias("q"))
    j = a.join(b, "key", "full_outer").fillna(0.0, ["p", "q"])
    w = Window.partitionBy(F.lit(0)).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("gap", F.abs(F.sum("p").over(w) - F.sum("q").over(w))).withColumn("m", (_K("p") + _K("q")) / 2)
    term = lambda x, y: F.when((_K(x) > 0) & (_K(y) > 0), _K(x) * F.ln(F.try_divide(_K(x), _K(y)))).otherwise(0.0)
    bc = F.sum(F.sqrt(_K("p") * _K("q")))
    return j.agg(F.sum(term("p", "q")).alias("kl"), (F.sum(term("p", "m")) / 2 + F.sum(term("q", "m")) / 2).alias("js"), F.avg("gap").alias("wasserstein"), F.when(bc > 0, -F.ln(bc)).otherwise(F.lit(float("inf"))).alias("bhattacharyya"))


def modes(d: DataFrame, keys: Sequence[str], least: float = 0.1) -> DataFrame:
    """Local maxima of a density with their prominence against the lowest valley beside them, relative to the highest."""
    w = Window.partitionBy(*keys).orderBy("k")
    left, right = F.min("density").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min("density").over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = d.withColumn("_p", F.lag("density").over(w)).withColumn("_n", F.lead("density").over(w)).withColumn("_v", F.greatest(left, right)).withColumn("_top", F.max("density").over(Window.partitionBy(*keys)))
    prominence = ratio(_K("density") - _K("_v"), _K("_top"))
    return rows.filter((_K("density") > F.coalesce("_p", F.lit(0.0))) & (_K("density") >= F.coalesce("_n", F.lit(0.0)))).withColumn("prominence", prominence).filter(_K("prominence") >= least).select(*keys, "x", "density", "prominence")


def compare(p: DataFrame, q: DataFrame) -> DataFrame:
    """Statistical likeness (mean of exp of the negated distances) and shape class of two histograms."""
    d = divergences(p, q)
    s = lambda h, n: histogram_stats(h.withColumn("_g", F.lit(1)), ["_g"]).select(_K("mean").alias(f"m{n}"), _K("std").alias(f"s{n}"))
    out = d.crossJoin(s(p, 1)).crossJoin(s(q, 2))
    like = (F.exp(-_K("js")) + F.exp(-_K("wasserstein")) + F.when(F.isnan("bhattacharyya") | (_K("bhattacharyya") > 700), 0.0).otherwise(F.exp(-_K("bhattacharyya")))) / 3
    moved, scaled = ratio(F.abs(_K("m1") - _K("m2")), F.greatest("s1", "s2")) > 0.5, ratio(F.abs(_K("s1") - _K("s2")), F.greatest("s1", "s2")) > 0.3
    shape = F.when(moved & scaled, "different").when(moved, "shifted").when(scaled, "scaled").otherwise("similar")
    return out.select("kl", "js", "wasserstein", "bhattacharyya", like.alias("similarity"), shape.alias("shape"))


def pairwise_js(h: DataFrame, key: str) -> DataFrame:
    """Jensen-Shannon divergence of every pair of histograms on common buckets, and exp(-js) as likeness."""
    share = h.select(key, "key", (_K("count") / F.sum("count").over(Window.partitionBy(key))).alias("p"))
    names = share.select(key).distinct()
    every = names.crossJoin(F.broadcast(share.select("key").distinct())).join(share, [key, "key"], "left").fillna(0.0)  # names x buckets, both bounded by the histograms
    a, b = every.select(_K(key).alias("a"), "key", "p"), every.select(_K(key).alias("b"), "key", _K("p").alias("q"))
    m = (_K("p") + _K("q")) / 2
    term = lambda x: F.when(_K(x) > 0, _K(x) * F.ln(F.try_divide(_K(x), m))).otherwise(0.0)
    return a.join(b, "key").filter("a < b").groupBy("a", "b").agg(((F.sum(term("p")) + F.sum(term("q"))) / 2).alias("js")).withColumn("similarity", F.exp(-_K("js")))
