"""Traces deeper than any fixture, and percentiles of whole tables, against brute force."""

import math
import random

import pytest

from tracelake.functions import stats
from tracelake.operators import trees

SPANS = "trace_id string, span_id string, parent_span_id string, service string, operation string, duration_ms double, is_error boolean, error_type string, start_ts long"


def test_a_trace_of_sixty_levels(spark):
    rows = [("t", f"s{i}", f"s{i - 1}" if i else None, f"svc-{i}", "op", 1.0, i >= 20, "E", i) for i in range(60)] + [("t", "side", "s3", "svc-x", "op", 40.0, False, None, 99)]
    df = spark.createDataFrame(rows, SPANS).coalesce(1)
    assert trees.critical_paths(df).first()["path"] == [f"s{i}" for i in range(60)]
    assert {r.span_id: r.depth for r in trees.span_paths(df).collect()} == {f"s{i}": i + 1 for i in range(60)} | {"side": 5}
    assert sorted(r.length for r in trees.error_chains(df).collect()) == list(range(2, 41))


def test_cycles_end(spark):
    rows = [("t", "a", None, "x", "o", 1.0, True, "E", 0), ("t", "b", "a", "y", "o", 1.0, True, "E", 1), ("t", "c", "d", "z", "o", 1.0, True, "E", 2), ("t", "d", "c", "w", "o", 1.0, True, "E", 3)]
    df = spark.createDataFrame(rows, SPANS)
    assert {r.span_id for r in trees.span_paths(df).collect()} == {"a", "b"}
    assert {(r.origin, r.length) for r in trees.error_chains(df).collect()} == {("b", 2), ("c", 2), ("d", 2)}


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_whole_table_percentiles(spark, n):
    r = random.Random(n)
    values = [r.choice([r.random() * 1e6, 5.0, r.randrange(30)]) * 1.0 for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 0.99, "f": 1.0}
    values.sort()
    near = {k: values[max(1, math.ceil(n * p)) - 1] if n else None for k, p in points.items()}
    floor = {k: values[min(math.floor(n * p) + 1, n) - 1] if n else None for k, p in points.items()}
    assert stats.rank_percentiles(df, [], "v", points).first().asDict() == near
    assert stats.rank_percentiles(df, [], "v", points, "floor").first().asDict() == floor
