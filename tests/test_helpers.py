"""Time helpers, the user's embedding function, metric reading, and means that only grow."""

from datetime import datetime

from pyspark.sql import functions as F

from tracelake.functions import timeutil as W
from tracelake.operators import aggregate as A
from tracelake.operators import vectors as V
from tracelake.sources import io


def test_times():
    now = datetime(2024, 5, 1, 12)
    assert W.default_range(now) == (datetime(2024, 5, 1, 11), now)
    assert [W.auto_interval(s, 100) for s in (0, 99, 1000, 86400 * 365)] == [1, 1, 10, 604800]
    assert W.previous_periods(datetime(2024, 1, 3), datetime(2024, 1, 4), 2) == [(datetime(2024, 1, 2), datetime(2024, 1, 3)), (datetime(2024, 1, 1), datetime(2024, 1, 2))]
    assert [W.horizon_points(t, "1h") for t in ("24h", "2d", "1w", "1month")] == [24, 48, 168, 720]


def test_time_formats(spark):
    df = spark.sql("select timestamp_ntz'2024-05-01 09:08:07' as t")
    assert list(df.select(*[W.format_time(F.col("t"), s).alias(s) for s in ("short", "medium", "long")]).first()) == ["09:08", "2024-05-01 09:08", "2024-05-01 09:08:07"]


def test_a_users_embedding(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "z"), (3, "abc"), (4, None), (5, " ")], "id int, text string")

    def lengths(texts):
        return [[float(len(t)), 1.0] for t in texts]

    got = {w.id: w.embedding for w in V.embed_column(df, "text", fn=lengths).collect()}
    assert got == {1: [3.0, 1.0], 2: [1.0, 1.0], 3: [3.0, 1.0], 4: None, 5: None}


def test_read_metrics_in_a_range(spark, tmp_path):
    df = spark.range(10).selectExpr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as ts", "'m' as metric", "cast(id as double) as value")
    io.write_table(df, str(tmp_path / "m"))
    got = io.read_metrics(spark, str(tmp_path / "m"), start=datetime(2024, 1, 1, 3), end=datetime(2024, 1, 1, 8), size=2, offset=1, sort=[F.desc("ts")])
    assert [w.value for w in got.collect()] == [7.0, 6.0]


def test_running_means_and_empty_histograms(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 2), ("a", 2, 2.0, 1), ("b", 1, 0.0, 0)], "k string, b int, total double, n int")
    assert {(w.k, w.b): w["mean"] for w in A.running_mean(df, ["k"], "b", "total", "n").collect()} == {("a", 1): 5.0, ("a", 2): 4.0, ("b", 1): 0.0}
    empty = spark.createDataFrame([], "ts timestamp_ntz")
    assert A.auto_date_histogram(empty, "ts", 10).count() == 0
