"""Canary verdicts: latency, errors, throughput and custom metrics of two services or versions, a score with its parts, a decision and risk factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.stats import grade, percent, step_p_value, two_proportions, welch
from tracelake.operators.regression import throughput_test

_K = F.col

#: Least score and grade, least score and decision.
GRADES = ((95, "A+"), (90, "A"), (85, "B+"), (80, "B"), (75, "C+"), (70, "C"), (60, "D"))
DECISIONS = ((85, "PROMOTE"), (70, "INVESTIGATE"))
#: Fixed value: p at which a difference counts.
SIGNIFICANT = 0.05


def canary_measures(spans: DataFrame, canary: str, baseline: str, seconds: int = 60, by: str = "service") -> DataFrame:
    """One row: requests, means and p99 of both sides, changes and p-values of latency, errors and throughput, new error types.

    Both sides come from one pass over the spans, throughput from another over its buckets.
    """
    sides, on = ((canary, 1), (baseline, 2)), lambda name: _K(by) == name
    aggs = []
    for name, p in sides:
        mine = lambda c: F.when(on(name), c)  # noqa: B023, E731  used at once
        aggs += [F.count_if(on(name)).alias(f"n{p}"), F.avg(mine(_K("duration_ms"))).alias(f"m{p}"), F.var_samp(mine(_K("duration_ms"))).alias(f"v{p}"), F.percentile(mine(_K("duration_ms")), F.lit(0.99)).alias(f"p99_{p}"), F.count_if(on(name) & _K("is_error")).alias(f"e{p}"), F.collect_set(mine(_K("error_type"))).alias(f"t{p}")]
    one = spans.filter(_K(by).isin(canary, baseline)).agg(*aggs)
    t, _, effect = welch(_K("m1"), _K("v1"), _K("n1"), _K("m2"), _K("v2"), _K("n2"))
    z = two_proportions(_K("e1"), _K("n1"), _K("e2"), _K("n2"))
    flow = throughput_test(spans.withColumn("service", _K(by)), canary, baseline, seconds).select(_K("change").alias("throughput_change"), _K("p").alias("throughput_p"))
    return one.select(
        _K("n1").alias("canary_n"), _K("n2").alias("baseline_n"), _K("p99_1").alias("canary_p99"), _K("p99_2").alias("baseline_p99"), percent(_K("m1") - _K("m2"), _K("m2")).alias("latency_change"), step_p_value(t).alias("latency_p"), effect.alias("effect"),
        (percent(_K("e1"), _K("n1")) - percent(_K("e2"), _K("n2"))).alias("error_change"), step_p_value(z).alias("error_p"), F.array_sort(F.array_except("t1", "t2")).alias("new_errors"),
    ).crossJoin(F.broadcast(flow))


def score_parts(measures: DataFrame) -> DataFrame:
    """part, change, points: what each significant loss costs (latency 30, errors 40, new error types 20, throughput 10 at most)."""
    sure = lambda p: _K(p) <= SIGNIFICANT
    parts = [
        ("latency", _K("latency_change"), F.when(sure("latency_p") & (_K("latency_change") > 0), F.least(F.lit(30.0), _K("latency_change") * 0.5))),
        ("errors", _K("error_change"), F.when(sure("error_p") & (_K("error_change") > 0), F.least(F.lit(40.0), _K("error_change") * 10))),
        ("new_errors", F.size("new_errors"), F.least(F.lit(20.0), F.size("new_errors") * 10.0)),
        ("throughput", _K("throughput_change"), F.when(sure("throughput_p") & (_K("throughput_change") < -10), F.least(F.lit(10.0), F.abs("throughput_change") * 0.2))),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("part"), c.cast("double").alias("change"), F.coalesce(p, F.lit(0.0)).alias("points")) for n, c, p in parts])
    return measures.select(F.explode(rows).alias("p")).select("p.*")


def verdict(parts: DataFrame) -> DataFrame:
    """One row: score, grade, decision and its confidence."""
    out = parts.agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.sum("points"))).alias("score"))
    return out.withColumn("grade", grade(_K("score"), GRADES, "F")).withColumn("decision", grade(_K("score"), DECISIONS, "ROLLBACK")).withColumn("confidence", F.when(_K("score") >= 95, "high").when(_K("score") >= 85, "medium").when(_K("score") >= 70, "low").otherwise("high"))


def risk_factors(measures: DataFrame) -> DataFrame:
    """risk, severity: a p99 half as long again, new timeout or circuit errors, over a fifth less throughput."""
    spreading = F.exists("new_errors", lambda e: F.lower(e).rlike("timeout|circuit"))
    rules = [("latency_tail", "high", _K("canary_p99") > _K("baseline_p99") * 1.5), ("error_cascade", "high", spreading), ("capacity_degradation", "medium", _K("throughput_change") < -20)]
    rows = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(n).alias("risk"), F.lit(s).alias("severity"))) for n, s, test in rules]))
    return measures.select(F.explode(rows).alias("r")).select("r.*")


def custom_metrics(metrics: DataFrame, canary: str, baseline: str, names: Sequence[str], by: str = "service") -> DataFrame:
    """metric, means of both sides and the change in % of the chosen metrics."""
    g = metrics.filter(_K("metric").isin(*names)).groupBy("metric").agg(*[F.avg(F.when(_K(by) == s, _K("value"))).cast("double").alias(n) for s, n in ((canary, "canary"), (baseline, "baseline"))])
    return g.withColumn("change", percent(_K("canary") - _K("baseline"), _K("baseline")))
