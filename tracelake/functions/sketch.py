"""Quantile sketches as rows: a value's bin is the power of (1 + e) / (1 - e) that it lies below.

A bin's middle is within the relative error e of all its values, so every quantile is too. A
sketch is (bin, count); sketches merge by adding counts, in any order, without losing anything.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bin of zeros; negative values have the mirrored bins below it. Values closer to zero than this count as zero.
ZERO, SMALLEST = 0, 1e-9


def _base(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("an error lies between 0 and 1")
    return math.log((1 + error) / (1 - error))


def bin_of(value: Column, error: float = 0.01) -> Column:
    """The number of the value's bin; null for null and NaN."""
    v = value.cast("double")
    away = F.ceil(F.log(F.abs(v) / SMALLEST) / _base(error)).cast("int") + 1
    return F.when(v.isNull() | F.isnan(v), None).when(F.abs(v) < SMALLEST, ZERO).when(v > 0, F.greatest(away, F.lit(1))).otherwise(-F.greatest(away, F.lit(1)))


def middle(number: Column, error: float = 0.01) -> Column:
    """The value that stands for a bin."""
    size = F.exp((F.abs(number) - 1) * _base(error)) * SMALLEST * (1 - error)
    return F.when(number == ZERO, 0.0).when(number > 0, size).otherwise(-size)


def merged(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, bin, count over all that isn't a key."""
    return sketches.filter(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.sum("count").alias("count"))


def quantiles(sketches: DataFrame, keys: Sequence[str], points: Mapping[str, float], error: float = 0.01) -> DataFrame:
    """keys, count, and for each name the value of rank ceil(p n) within the relative error; windows run over bins, not over rows."""
    rows = merged(sketches, keys)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum("count").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumn("_to", upto).withColumn("_all", F.sum("count").over(group))
    hit = lambda p: F.min(F.when(F.col("_to") >= F.greatest(F.ceil(F.lit(float(p)) * F.col("_all")), F.lit(1)), F.col("bin")))
    out = ranked.groupBy(*keys).agg(F.max("_all").alias("count"), *[hit(p).alias(name) for name, p in points.items()])
    return out.withColumns({name: middle(F.col(name), error) for name in points})
