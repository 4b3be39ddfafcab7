"""Streams: late rows, bounded state, batches written once, and sketches."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import sketch
from tracelake.sources.io import stream_table
from tracelake.streaming import live as S


def files(spark, path, batches, schema):
    """One file a batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).selectExpr("*", "cast(at as timestamp) as ts").drop("at").coalesce(1).write.mode("append").parquet(path)
    return stream_table(spark, path, spark.read.parquet(path).schema, "ts", files_per_trigger=1)


def minute(m):
    return f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    batches = [[("a", minute(60))], [("b", minute(61))], [("c", minute(52)), ("d", minute(49))], [("e", minute(62))]]  # the watermark is 10 minutes behind 1:00
    stream = files(spark, str(tmp_path / "in"), batches, "id string, at string")
    watched = S.Watched()
    spark.streams.addListener(watched)
    try:
        kept = S.drain(S.without_duplicates(stream, ["id"], "10 minutes"))
        assert {w.id for w in kept.collect()} == {"a", "b", "c", "e"}
        for _ in range(100):
            if sum(watched.dropped.values()):
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(watched)
    assert sum(watched.dropped.values()) == 1 and {k[1] for k in watched.dropped} == {"0:dedupeWithinWatermark"}


def test_live_edges_keep_their_state_bounded(spark, tmp_path):
    r, batches, want = random.Random(1), [], 0
    for b in range(12):
        rows = []
        for t in range(40):
            at, trace = b * 60 + r.randrange(55), f"{b}-{t}"
            rows.append((trace, "0", None, "web", minute(at), False, 1.0))
            rows.append((trace, "1", "0", "db", minute(at + r.randrange(5)), False, 1.0))
            want += 1
        batches.append(rows)
    stream = files(spark, str(tmp_path / "in"), batches, "trace_id string, span_id string, parent_span_id string, service string, at string, is_error boolean, duration_ms double")
    progress = []
    edges = S.drain(S.live_edges(stream, "1 minute", "5 minutes"), progress=progress)
    assert edges.count() == want
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress if p["numInputRows"]]
    assert len(held) == 12 and max(held) <= 3 * 2 * 80  # two batches of both sides, and no more however long it runs


def test_a_batch_written_again_stays_one(spark, tmp_path):
    path = str(tmp_path / "out")
    write = S.write_once(path)
    rows = spark.range(5)
    write(rows, 0)
    write(rows.selectExpr("id + 5 as id"), 1)
    write(rows.selectExpr("id + 5 as id"), 1)
    assert sorted((w.id, w["_batch"]) for w in spark.read.parquet(path).collect()) == [(i, i // 5) for i in range(10)]


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_sketches_merge_and_stay_within_their_error(spark, error):
    r = random.Random(2)
    values = [r.choice([0.0, r.gauss(0, 3), r.lognormvariate(0, 4), -r.lognormvariate(2, 2)]) for _ in range(3000)] + [None, float("nan"), 1e-300]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "k int, v double").withColumn("bin", sketch.bin_of(F.col("v"), error))
    points = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    parts = df.groupBy("k", "bin").agg(F.count("*").alias("count"))
    whole = sketch.quantiles(df.groupBy("bin").agg(F.count("*").alias("count")), [], points, error).first()
    assert sketch.quantiles(parts, [], points, error).first() == whole
    real = sorted(v for v in values if v is not None and v == v)
    assert whole["count"] == len(real)
    for name, p in points.items():
        true = real[max(-(-int(p * 10000) * len(real) // 10000), 1) - 1]
        assert abs(whole[name] - true) <= error * abs(true) * 1.000001 + sketch.SMALLEST


def test_drained_edges_equal_live_ones(spark, tmp_path):
    r, batches = random.Random(3), []
    for b in range(8):
        rows = []
        for t in range(30):
            at, trace = b * 60 + r.randrange(60), f"{b}-{t}"
            rows += [(trace, str(i), str(i - 1) if i else None, "web db cache".split()[i], minute(at + i * r.randrange(4)), i == 2, 1.0) for i in range(3)]
        batches.append(rows)
    for b in range(7):  # some spans arrive a batch late
        batches[b + 1] += batches[b][::7]
        batches[b] = [x for i, x in enumerate(batches[b]) if i % 7]
    schema = "trace_id string, span_id string, parent_span_id string, service string, at string, is_error boolean, duration_ms double"
    stream = files(spark, str(tmp_path / "in"), batches, schema)
    want, got = (sorted(map(tuple, f.select("source", "target", "ts", "is_error", "duration_ms").collect())) for f in (S.drain(S.live_edges(stream, "2 hours", "5 minutes")), S.drained_edges(stream, "2 hours", "5 minutes")))
    near = sum(i > 0 and x[4] is not None for rows in batches for x in rows for i in [int(x[1])])
    assert got == want and 0 < len(got) <= near


def test_steps_of_many_rows_have_equal_numbers_of_files(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.range(3000).selectExpr("id", "timestamp'2024-01-01 00:00:00' as ts")
    assert S.in_order(df, (F.col("id") / 1000).cast("int"), path, 250) == 4
    assert len(spark.read.parquet(path).inputFiles()) == 12
    got = S.drain(stream_table(spark, path, df.schema, "ts", files_per_trigger=4)).groupBy("_batch").agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()
    assert sorted((w["_batch"], w.a, w.b) for w in got) == [(k, 1000 * k, 1000 * k + 999) for k in range(3)]
