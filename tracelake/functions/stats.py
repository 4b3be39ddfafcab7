"""Percentile flavours, moments, tests and series formulas as columns and small plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.lineage import cut_lineage


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(otherwise))


def percent(a: Column, b: Column) -> Column:
    return ratio(a * 100.0, b)


#: Rows (keys, value, count) up to which ranks come from one window a group; beyond, from ranges.
MOST_RANKED = 1_000_000


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value and ``_n``, nulls too, written once, so that what is ranked is not computed again."""
    return cut_lineage(df.groupBy(*keys, value).agg(F.count("*").alias("_n")))


def rank_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], flavour: str = "nearest", counted: bool = False) -> DataFrame:
    """Exact rank percentiles per group: ``nearest`` takes rank ceil(p n), ``floor`` rank floor(p n) + 1.

    Equal values are counted before they are ranked, so a group's rows never meet one by one;
    ``counted`` rows are those of ``value_counts``. Without keys, only the values close to a rank
    are ordered.
    """
    if not keys:
        return _overall_percentiles(df, value, points, flavour)
    counts = df if counted else value_counts(df, keys, value)
    return _at_ranks(counts, keys, value, {name: _rank(p, flavour) for name, p in points.items()}).drop("_all")


def interpolated_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], counted: bool = False) -> DataFrame:
    """Exact percentiles per group between the two values around (n - 1) p, as ``F.percentile`` gives them, without holding a group in a task."""
    counts = df if counted else value_counts(df, keys, value)
    spot = {name: (F.col("_all") - 1) * F.lit(float(p)) for name, p in points.items()}
    ranks = {f"_{side}_{name}": step(x) + 1 for name, x in spot.items() for side, step in (("lo", F.floor), ("hi", F.ceil))}
    out = _at_ranks(counts, keys, value, ranks)
    double = lambda name: F.col(name).cast("double")
    found = {}
    for name, x in spot.items():
        lo, hi = double(f"_lo_{name}"), double(f"_hi_{name}")
        found[name] = F.when(F.floor(x) == F.ceil(x), lo).otherwise((F.ceil(x) - x) * lo + (x - F.floor(x)) * hi)
    return out.select(*keys, *[c.alias(name) for name, c in found.items()])


def _at_ranks(counts: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys, ``_all`` and for each name the value at a rank (from 1), an expression of ``_all``; a group without values has no row.

    Many counts are dealt by ranges of (keys, value). Sums of ranges tell where a rank lies, and
    only the ranges that hold one are ordered within.
    """
    counts = counts.filter(F.col(value).isNotNull()).select(*keys, value, "_n")
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = lambda w, by, n: F.sum(n).over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = lambda rank: (F.col("_to") - F.col("_n") < rank) & (rank <= F.col("_to"))
    if counts.count() <= MOST_RANKED:
        ranked = counts.withColumn("_to", upto(group, value, "_n")).withColumn("_all", F.sum("_n").over(group))
    else:
        dealt = cut_lineage(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
        sums = dealt.groupBy(*keys, "_range").agg(F.sum("_n").alias("_n"))
        sums = sums.withColumn("_to", upto(group, "_range", "_n")).withColumn("_all", F.sum("_n").over(group))
        holds = sums.filter(F.exists(F.array(*ranks.values()), at))
        ends = cut_lineage(holds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), (F.col("_to") - F.col("_n")).alias("_before"), "_all"))
        same = F.col("_range") == F.col("_r")
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        inner = Window.partitionBy(*keys, "_range")
        ranked = dealt.join(ends, same).withColumn("_to", F.col("_before") + upto(inner, value, "_n"))
    first = [F.max("_all").alias("_all")]
    return ranked.groupBy(*keys).agg(*first, *[F.max(F.when(at(rank), F.col(value))).alias(name) for name, rank in ranks.items()])


def _rank(p: float, flavour: str) -> Column:
    x = F.col("_all") * F.lit(float(p))
    return F.least(F.floor(x) + 1, F.col("_all")) if flavour == "floor" else F.greatest(F.ceil(x), F.lit(1))


def _overall_percentiles(df: DataFrame, value: str, points: dict[str, float], flavour: str, accuracy: int = 10_000) -> DataFrame:
    """One row of exact rank percentiles of a whole table.

    A quantile sketch gives two values that enclose each rank; the rows below them are counted,
    and only those between them, a few in ``accuracy``, are ordered.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
    margin, ps = 4.0 / accuracy, list(points.values())
    near = rows.agg(
        F.percentile_approx("_v", [max(0.0, p - margin) for p in ps], accuracy).alias("_lo"),
        F.percentile_approx("_v", [min(1.0, p + margin) for p in ps], accuracy).alias("_hi"), F.count("*").alias("_all"),
    )
    met = rows.crossJoin(F.broadcast(near))  # one row
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(ps) - 1)), lambda i: F.col("_v") <= F.get("_hi", i))).alias("_i")
    low = F.col("_v") < F.get("_lo", F.col("_i"))
    # what lies below the lower value is one row of the count, whatever its values
    counts = met.select("_v", "_lo", "_all", at).groupBy("_i", F.when(~low, F.col("_v")).alias("_v"), "_all").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("_to", upto)
    out = []
    for k, (name, p) in enumerate(points.items()):
        rank = _rank(p, flavour)
        hit = (F.col("_i") == k) & (F.col("_to") - F.col("_n") < rank) & (rank <= F.col("_to"))
        enclosed = F.coalesce("_v", F.raise_error(F.lit("the sketch missed a rank")).cast(df.schema[value].dataType))
        out.append(F.max(F.when(hit, enclosed)).alias(name))
    return ranked.agg(*out)


def linear_percentiles(value: str, points: dict[str, float], exact: bool = True, accuracy: int = 10_000) -> list[Column]:
    """Interpolated percentiles; the approximate form bounds memory for huge groups."""
    if exact:
        return [F.percentile(value, F.lit(p)).alias(k) for k, p in points.items()]
    return [F.percentile_approx(value, F.lit(p), F.lit(accuracy)).cast("double").alias(k) for k, p in points.items()]


def extended_stats(value: str) -> list[Column]:
    v = F.col(value)
    return [F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_of_squares"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("std")]


def weighted_mean(value: Column, weight: Column) -> Column:
    return ratio(F.sum(value * weight), F.sum(weight))


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return ratio(F.abs(value - mean), std)


def step_p_value(z: Column) -> Column:
    """Two-sided p-value in the usual steps of a statistic's size."""
    a = F.abs(z)
    return F.when(a > 3.291, 0.001).when(a > 2.576, 0.01).when(a > 1.96, 0.05).when(a > 1.645, 0.1).otherwise(0.2)


def normal_p_value(z: Column) -> Column:
    """Two-sided p-value of the normal distribution (Abramowitz-Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def welch(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """(t, degrees of freedom, pooled effect size)."""
    a, b = ratio(v1, n1), ratio(v2, n2)
    t = ratio(m1 - m2, F.sqrt(a + b))
    df = ratio((a + b) * (a + b), ratio(a * a, n1 - 1) + ratio(b * b, n2 - 1))
    pooled = F.sqrt(ratio((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    return t, df, ratio(m1 - m2, pooled)


def two_proportions(e1: Column, n1: Column, e2: Column, n2: Column) -> Column:
    p = ratio(e1 + e2, n1 + n2)
    return ratio(ratio(e1, n1) - ratio(e2, n2), F.sqrt(p * (1 - p) * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2))))


def grade(score: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """The name of the first step that the score reaches."""
    out = F.when(score >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        out = out.when(score >= least, name)
    return out.otherwise(last)


def numbered(df: DataFrame, keys: Sequence[str], *order: str, name: str = "i") -> DataFrame:
    """0-based place of each row in its series."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) - 1)


def smoothed(values: Column, alpha: float) -> Column:
    """Exponential smoothing of an array, as an array of the same length."""
    a = F.lit(float(alpha))
    start = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = F.coalesce(a * x + (1 - a) * acc["s"], x)
        return F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out"))

    return F.aggregate(values.cast("array<double>"), start, step, lambda acc: acc["out"])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
