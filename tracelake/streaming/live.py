"""Structured Streaming operators over spans, logs and metrics with event time ``ts``.

All take a streaming DataFrame whose ``ts`` is a TIMESTAMP; a watermark bounds their state and
decides what is late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from tracelake.functions import sketch
from tracelake.shipping import ship


def binned(df: DataFrame, window: str, keys: Sequence[str] = (), watermark: str = "10 minutes", value: str = "value", error: float = 0.01) -> DataFrame:
    """start, keys, bin, count: a quantile sketch of each window as rows, see ``functions.sketch``.

    Sketches of the same error merge by adding the counts of equal bins, over windows and keys
    alike, and what is merged equals the sketch of the whole.
    """
    out = df.withWatermark("ts", watermark).groupBy(F.window("ts", window), *keys, sketch.bin_of(F.col(value), error).alias("bin")).agg(F.count("*").alias("count"))
    return out.select(F.col("window.start").alias("start"), *keys, "bin", "count")


def tumbling(df: DataFrame, window: str, keys: Sequence[str] = (), watermark: str = "10 minutes", value: str = "value") -> DataFrame:
    """Counts, mean and approximate percentiles of each window."""
    w = F.window("ts", window)
    out = df.withWatermark("ts", watermark).groupBy(w, *keys)
    return out.agg(F.count("*").alias("count"), F.avg(value).alias("avg"), F.percentile_approx(value, [0.5, 0.95, 0.99]).alias("p")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "count", "avg", "p")


def sliding(df: DataFrame, window: str = "10 minutes", slide: str = "1 minute", keys: Sequence[str] = (), watermark: str = "10 minutes") -> DataFrame:
    """Rates smoothed over overlapping windows."""
    out = df.withWatermark("ts", watermark).groupBy(F.window("ts", window, slide), *keys).agg(F.count("*").alias("count"))
    return out.select(F.col("window.start").alias("start"), *keys, "count")


def sessions(df: DataFrame, keys: Sequence[str], gap: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Runs of events of a key without a longer gap."""
    out = df.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("count"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "count")


EDGE = ("source", "target", "ts", "is_error", "duration_ms")


def _paired(children: DataFrame, parents: DataFrame, apart: str, *more: str) -> DataFrame:
    """Child rows with their parents' service, at most ``apart`` from them in time; ``more`` columns of the parents come as ``_<name>``."""
    p = parents.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("service").alias("source"), F.col("ts").alias("_pts"), *[F.col(c).alias(f"_{c}") for c in more])
    c = children.select("trace_id", "parent_span_id", F.col("service").alias("target"), "ts", "is_error", "duration_ms", *more)
    near = F.expr(f"ts >= _pts - interval {apart} and ts <= _pts + interval {apart}")
    return c.join(p, (F.col("trace_id") == F.col("_t")) & (F.col("parent_span_id") == F.col("_s")) & near).filter("source <> target")


def live_edges(spans: DataFrame, watermark: str = "10 minutes", apart: str = "10 minutes") -> DataFrame:
    """Child spans joined with their parents of the stream: source, target, ts, is_error, duration_ms."""
    timed = spans.withWatermark("ts", watermark)
    return _paired(timed, timed, apart).select(*EDGE)


def drained_edges(spans: DataFrame, watermark: str = "10 minutes", apart: str = "10 minutes") -> DataFrame:
    """The rows of ``live_edges`` over what is there now, for batches of many spans: a table in the shared checkpoint folder.

    A state store keeps every span of a batch on both sides before it drops them again. Here a
    batch is joined with itself and with the spans before it that the watermark still lets a span
    meet; these are a table, which each batch writes for the next. A span further behind the
    spans before its batch than the watermark is left out; ``live_edges`` may still take such a one.
    """
    import uuid

    from tracelake.functions.lineage import shared_folder

    base = f"{shared_folder(spans.sparkSession)}/edges-{uuid.uuid4().hex}"
    rows = spans.select("trace_id", "span_id", "parent_span_id", "service", "ts", "is_error", "duration_ms")
    write_edges, write_held = write_once(f"{base}/rows"), write_once(f"{base}/held")
    last = lambda df: df.agg(F.unix_micros(F.max("ts"))).first()[0]
    mark = lambda micros: F.timestamp_micros(F.lit(micros)) - F.expr(f"interval {watermark}")

    def batch(new: DataFrame, k: int) -> None:
        new = new.withColumn("_new", F.lit(True))
        if k:
            held = new.sparkSession.read.schema(rows.schema).parquet(f"{base}/held/_batch={k - 1}").withColumn("_new", F.lit(False))
            before = last(held)
            new = held.unionByName(new if before is None else new.filter(F.col("ts") > mark(before)))
        write_edges(_paired(new, new, apart, "_new").filter("_new or __new").select(*EDGE), k)
        now = last(new)
        write_held(new.drop("_new").filter(F.lit(False) if now is None else F.col("ts") >= mark(now) - F.expr(f"interval {apart}")), k)

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spans.sparkSession.read.schema(_paired(rows, rows, apart).select(*EDGE).schema).parquet(f"{base}/rows")


def without_duplicates(spans: DataFrame, keys: Sequence[str] = ("trace_id", "span_id"), watermark: str = "10 minutes") -> DataFrame:
    return spans.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def enriched(df: DataFrame, services: DataFrame) -> DataFrame:
    """Stream rows with a static table of services."""
    return df.join(services, "service", "left")


DRIFT = "service string, start timestamp, count long, error_rate double, mean double, volume_drift double, error_drift double, mean_drift double"
DRIFT_NAMES = [c.split()[0] for c in DRIFT.split(", ")]


def drift(df: DataFrame, window_s: int = 3600, watermark: str = "10 minutes", error: str = "level = 'error'", value: str = "value") -> DataFrame:
    """Each closed window of a service against its closed window before: volume, error rate and mean value.

    The state of a service is its open windows (as many as the watermark spans) and the last
    closed one; a window is sent once, when the watermark passes its end, so late rows can't
    change what was sent.
    """
    ship(df.sparkSession)
    from pyspark.sql.streaming.state import GroupStateTimeout

    width = window_s * 1000
    rows = df.withWatermark("ts", watermark).select("service", "ts", F.unix_millis("ts").alias("ms"), F.expr(error).cast("double").alias("bad"), F.col(value).cast("double").alias("value"))

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        starts, counts, bad, sums, last = (list(x) for x in state.get) if state.exists else ([], [], [], [], [])
        open_ = {s: [c, b, v] for s, c, b, v in zip(starts, counts, bad, sums, strict=True)}
        now = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for b in batches:
                b = b.assign(start=b["ms"] // width * width)
                for s, g in b[b["start"] + width > now].groupby("start"):
                    held = open_.setdefault(int(s), [0, 0.0, 0.0])
                    held[0] += len(g)
                    held[1] += float(g["bad"].sum())
                    held[2] += float(g["value"].sum())
        out = []
        for s in sorted(s for s in open_ if s + width <= now):
            n, b, v = open_.pop(s)
            new = [float(n), b / n, v / n]
            change = [(new[0] - last[0]) / last[0], new[1] - last[1], (new[2] - last[2]) / last[2] if last[2] else 0.0] if last else [None] * 3
            out.append((key[0], pd.Timestamp(s, unit="ms"), n, new[1], new[2], *change))
            last = new
        left = sorted(open_)
        state.update(tuple([left, *([open_[s][i] for s in left] for i in range(3)), last]))
        if left:
            state.setTimeoutTimestamp(max(left[0] + width, now + 1))
        yield pd.DataFrame(out, columns=DRIFT_NAMES).astype({"start": "datetime64[ns]", "count": "int64", **{c: float for c in DRIFT_NAMES[3:]}})

    kinds = "starts array<long>, counts array<long>, bad array<double>, sums array<double>, last array<double>"
    return rows.groupBy("service").applyInPandasWithState(run, DRIFT, kinds, "append", GroupStateTimeout.EventTimeTimeout)


def write_once(path: str, each: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch to the folder of its id, so a batch that is tried again replaces what it had written.

    Reading ``path`` gives the rows with their batch id as ``_batch``.
    """

    def batch(rows: DataFrame, k: int) -> None:
        (each(rows) if each else rows).write.format(fmt).mode("overwrite").save(f"{path}/_batch={k}")

    return batch


def assign_clusters(df: DataFrame, model_path: str, path: str, checkpoint: str):
    """A query that writes each batch once, with the clusters of the k-means model that was saved at ``model_path``."""
    from pyspark.ml.clustering import KMeansModel

    model = KMeansModel.load(model_path)
    return df.writeStream.foreachBatch(write_once(path, model.transform)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


class Watched(StreamingQueryListener):
    """What the stateful operators of running queries report: rows dropped as late, and state rows of each batch.

    ``dropped`` sums by (query, operator); ``state`` has a list (batch, state rows) for each query.
    Add it with ``spark.streams.addListener``.
    """

    def __init__(self) -> None:
        self.dropped: dict[tuple[str, str], int] = {}
        self.state: dict[str, list[tuple[int, int]]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name, rows = p.name or str(p.id), 0
        for i, s in enumerate(p.stateOperators):
            key = (name, f"{i}:{s.operatorName}")
            self.dropped[key] = self.dropped.get(key, 0) + s.numRowsDroppedByWatermark
            rows += s.numRowsTotal
        if p.stateOperators:
            self.state.setdefault(name, []).append((p.batchId, rows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(progress: dict) -> int:
    """Rows that a query's last progress dropped as late."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for s in progress.get("stateOperators", []))


def in_order(df: DataFrame, step: Column, path: str, rows_a_file: int | None = None) -> int:
    """Writes the rows as one file set a step, in the order of the steps, as if they had arrived that way; the files of a step.

    These are as many as the smallest step has ``rows_a_file``, so that a stream that takes so many
    files at a time takes a step at a time; one file a step where none is given.
    """
    spark = df.sparkSession
    rows = df.withColumn("_step", step)
    rows.write.partitionBy("_step").parquet(f"{path}-steps")
    kept = spark.read.parquet(f"{path}-steps")
    steps = {r[0]: r[1] for r in kept.groupBy("_step").count().collect()}
    files = max(1, min(steps.values(), default=0) // rows_a_file) if rows_a_file else 1
    for k in sorted(steps):
        one = kept.filter(F.col("_step") == k).drop("_step")
        # rows are dealt in turns, and a task has far more of them than there are files, so none stays empty
        (one.repartition(files) if files > 1 else one.coalesce(1)).write.mode("append").parquet(path)
    return files


def drain(df: DataFrame, mode: str = "append", each: Callable | None = None, progress: list | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives its rows as a table in the shared checkpoint folder.

    ``progress`` gets the progress of each batch that had rows or state.
    """
    import uuid

    from tracelake.functions.lineage import shared_folder

    spark = df.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.foreachBatch(write_once(f"{base}/rows", each)).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    if each is not None:
        return spark.read.parquet(f"{base}/rows")
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{base}/rows")
