"""Critical paths trace by trace against the same by one join a level."""

import random

import pytest

from tracelake.operators import trees

SCHEMA = "trace_id string, span_id string, parent_span_id string, service string, operation string, duration_ms double"


def forest(seed, traces, most):
    r = random.Random(seed)
    rows = []
    for t in range(traces):
        n = r.randrange(1, most)
        for i in range(n):
            parent = None if i == 0 or r.random() < 0.05 else r.choice([f"s{r.randrange(i)}", f"s{r.randrange(i)}", f"s{i}", "gone", f"s{r.randrange(n)}"])
            rows.append((f"t{t}", f"s{i}" if r.random() < 0.97 else f"s{r.randrange(n)}", parent, f"v{r.randrange(4)}", "o", r.choice([1.0, 2.0, 0.1, 0.2, 3.5])))
    return rows + [(None, "a", None, "v", "o", 1.0), (None, "b", "a", "v", "o", 4.0), ("n", None, None, "v", "o", 2.0), ("n", "x", None, "v", "o", 1.0), ("m", "x", None, "v", "o", None), ("m", "y", None, "v", "o", 9.0)]


def found(df):
    return sorted((str(w.trace_id), str(w.path), str(w.services), str(w.durations), None if w.total is None else round(w.total, 9)) for w in df.collect())


@pytest.mark.parametrize(("seed", "traces", "most", "depth"), [(1, 60, 12, None), (2, 40, 30, 3)])
def test_equals_levels(spark, seed, traces, most, depth):
    df = spark.createDataFrame(forest(seed, traces, most), SCHEMA).repartition(3)
    want = found(trees._paths_by_level(df, depth))
    assert found(trees.critical_paths(df, depth)) == want and len(want) > 30
    assert found(trees.critical_paths(df, depth, most_spans=8)) == want  # the larger ones by level


def test_a_thousand_levels_and_many_batches(spark):
    rows = [("t", f"s{i:04d}", f"s{i - 1:04d}" if i else None, "v", "o", 1.0) for i in range(1000)] + [("u", "r", None, "v", "o", 1.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {w.trace_id: (len(w.path), w.total) for w in trees.critical_paths(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"t": (1000, 1000.0), "u": (1, 1.0)}
