"""Span-tree operators by level-wise joins: depth, critical path, error propagation, root-to-leaf paths.

All of them stay within a trace; a span whose parent is missing or itself is a root. Critical
paths are found trace by trace after one exchange; for the others each level is one join on (trace, span) with the level before, which is written to the shared folder, so
work grows with the depth and a trace of any size or depth is followed to its end; paths carry
what they have visited, so cycles end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.lineage import cut_lineage
from tracelake.functions.stats import percent, rank_percentiles, ratio

#: Spans of a trace that one task may hold, and ids of larger traces that may be sent to every task.
MOST_SPANS, MOST_SENT = 200_000, 100_000
_PATH_COLUMNS = ("trace_id", "span_id", "service", "operation", "duration_ms")


def with_roots(spans: DataFrame) -> DataFrame:
    """Spans with ``is_root``: no parent, itself as parent, or a parent that the trace doesn't have."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_found")).distinct()
    own = F.col("parent_span_id") == F.col("span_id")
    return spans.join(parents, ["trace_id", "parent_span_id"], "left").withColumn("is_root", F.col("parent_span_id").isNull() | own | F.col("_found").isNull()).drop("_found")


def _levels(first: DataFrame, following, max_depth: int | None) -> DataFrame:
    """All rows of ``first``, ``following(first)`` and so on until a level is empty, or up to ``max_depth`` levels; each is written once."""
    level = cut_lineage(first)
    out, depth = level, 1
    while max_depth is None or depth < max_depth:
        level = cut_lineage(following(level))
        if level.isEmpty():
            break
        out, depth = out.unionByName(level), depth + 1
    return out


def span_paths(spans: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every span with its path from its root: arrays of span ids, services and durations, and its depth.

    One join a level, until no span is left or ``max_depth`` levels are read; a span already on the path ends it, so cycles don't loop.
    """
    rows = cut_lineage(with_roots(spans).select("trace_id", "span_id", "parent_span_id", "service", "operation", "duration_ms", "is_root"))
    child = rows.filter("not is_root").select("trace_id", F.col("parent_span_id").alias("_p"), F.col("span_id").alias("_s"), F.col("service").alias("_v"), F.col("operation").alias("_o"), F.col("duration_ms").alias("_d"))
    roots = rows.filter("is_root").select("trace_id", "span_id", F.array("span_id").alias("path"), F.array("service").alias("services"), F.array("operation").alias("operations"), F.array("duration_ms").alias("durations"))

    def below(level: DataFrame) -> DataFrame:
        level = level.withColumnRenamed("span_id", "_p").join(child, ["trace_id", "_p"]).filter(~F.array_contains("path", F.col("_s")))
        return level.select(
            "trace_id", F.col("_s").alias("span_id"), F.concat("path", F.array("_s")).alias("path"), F.concat("services", F.array("_v")).alias("services"),
            F.concat("operations", F.array("_o")).alias("operations"), F.concat("durations", F.array("_d")).alias("durations"),
        )

    return _levels(roots, below, max_depth).withColumn("depth", F.size("path"))


def leaves(paths: DataFrame, spans: DataFrame) -> DataFrame:
    """Paths that end in a span without children."""
    parents = spans.filter("parent_span_id is not null and parent_span_id <> span_id").select("trace_id", F.col("parent_span_id").alias("span_id")).distinct()
    return paths.join(parents, ["trace_id", "span_id"], "left_anti")


def critical_paths(spans: DataFrame, max_depth: int | None = None, min_duration: float = 0.0, most_spans: int = MOST_SPANS) -> DataFrame:
    """Per trace the path of the largest summed duration; spans below ``min_duration`` are passed through but not listed.

    From each root the child with the largest sum along its path is followed, which is the
    root-to-leaf path of the largest sum; ties go to the smallest path of ids. Traces are dealt
    once, and a task reads one trace at a time; those of over ``most_spans`` spans, which no task
    should hold, are followed level by level instead.
    """
    columns = [*_PATH_COLUMNS, "parent_span_id"]
    large = cut_lineage(spans.groupBy("trace_id").agg(F.count("*").alias("n")).filter(F.col("n") > most_spans).select(F.col("trace_id").alias("_t")))
    few = large.count()
    rows = spans.select(*columns)
    if few:
        hint = F.broadcast(large) if few <= MOST_SENT else large
        big = F.col("trace_id").eqNullSafe(F.col("_t"))
        rows = rows.join(hint, big, "left_anti")
    out = _paths_by_trace(rows, max_depth)
    if few:
        out = out.unionByName(_paths_by_level(spans.join(hint, big, "left_semi"), max_depth))
    if min_duration > 0:
        keep = F.filter(F.arrays_zip("path", "services", "operations", "durations"), lambda s: s["durations"] >= min_duration)
        out = out.withColumn("_k", keep).select("trace_id", "total", *[F.col(f"_k.{c}").alias(c) for c in ("path", "services", "operations", "durations")])
    return out


def _paths_by_level(spans: DataFrame, max_depth: int | None) -> DataFrame:
    """trace_id, path, services, operations, durations, total of the critical paths, by one join a level."""
    ends = leaves(span_paths(spans, max_depth), spans)
    total = F.aggregate("durations", F.lit(0.0), lambda a, x: a + x)
    best = ends.withColumn("total", total).groupBy("trace_id").agg(F.min_by(F.struct("path", "services", "operations", "durations", "total"), F.struct(-F.col("total"), F.col("path"))).alias("b"))
    return best.select("trace_id", "b.*")


def critical_rows(trace, ids: list, parents: list, ms: list, max_depth: int | None) -> tuple[list[int], float | None] | None:
    """Row numbers of one trace's critical path, and its sum; None where no path ends in a leaf.

    Sums run from the root on. A row whose id is missing is no child; a sum with a missing
    duration is missing and comes first.
    """
    own = set(ids) if trace is not None else set()
    below: dict = {}
    inner = set()
    roots = []
    for i, (x, p) in enumerate(zip(ids, parents, strict=True)):
        if trace is not None and p is not None and p != x:
            inner.add(p)
        if p is None or p == x or p not in own:
            roots.append(i)
        elif x is not None:
            below.setdefault(p, []).append(i)
    once = len(own) == len(ids)  # each row has one parent then, and no cycle hangs on a root
    # entries: (row, entry of the parent, sum, depth)
    entries = [(i, -1, None if ms[i] is None else 0.0 + float(ms[i]), 1) for i in roots]
    best, tied = None, []
    at = 0

    def chain(e: int) -> list[int]:
        out = []
        while e >= 0:
            out.append(entries[e][0])
            e = entries[e][1]
        return out[::-1]

    while at < len(entries):
        i, _, total, depth = entries[at]
        x = ids[i]
        if x is None or x not in inner:
            key = (total is not None, -(total or 0.0))
            if best is None or key < best:
                best, tied = key, [at]
            elif key == best:
                tied.append(at)
        if max_depth is None or depth < max_depth:
            children = below.get(x, ()) if x is not None else ()
            if children and not once:
                seen = {ids[r] for r in chain(at)}
                children = [c for c in children if ids[c] not in seen]
            for c in children:
                entries.append((c, at, None if total is None or ms[c] is None else total + float(ms[c]), depth + 1))
        at += 1
    if best is None:
        return None
    paths = [chain(e) for e in tied]
    rows = min(paths, key=lambda path: [(ids[r] is not None, ids[r]) if ids[r] is not None else (False, "") for r in path]) if len(paths) > 1 else paths[0]
    return rows, entries[tied[0]][2]


def _paths_by_trace(rows: DataFrame, max_depth: int | None) -> DataFrame:
    """trace_id, path, services, operations, durations, total of the critical paths; a task holds the spans of one trace at a time."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from tracelake.shipping import ship

    ship(rows.sparkSession)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    lists = {"path": "span_id", "services": "service", "operations": "operation", "durations": "duration_ms"}
    schema = T.StructType([T.StructField("trace_id", kinds["trace_id"]), *[T.StructField(n, T.ArrayType(kinds[c])) for n, c in lists.items()], T.StructField("total", T.DoubleType())])

    def run(batches):
        held: list[pa.Table] = []

        def found(table: pa.Table, bounds: list[tuple[int, int]]) -> pa.RecordBatch:
            ids, parents, ms, traces = (table.column(c).to_pylist() for c in ("span_id", "parent_span_id", "duration_ms", "trace_id"))
            names, take, ends, totals = [], [], [0], []
            for lo, hi in bounds:
                one = critical_rows(traces[lo], ids[lo:hi], parents[lo:hi], ms[lo:hi], max_depth)
                if one is not None:
                    names.append(lo)
                    take += [lo + r for r in one[0]]
                    ends.append(len(take))
                    totals.append(one[1])
            at, offsets = pa.array(take, pa.int64()), pa.array(ends, pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, table.column(c).take(at).combine_chunks()) for c in lists.values()]
            first = table.column("trace_id").take(pa.array(names, pa.int64())).combine_chunks()
            return pa.RecordBatch.from_arrays([first, *arrays, pa.array(totals, pa.float64())], [*("trace_id", *lists), "total"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held and t.column("trace_id")[0].as_py() == held[0].column("trace_id")[0].as_py() == t.column("trace_id")[-1].as_py():
                held.append(t)  # a trace of several batches goes on
                continue
            t = pa.concat_tables([*held, t])
            names = t.column("trace_id").to_pylist()
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])]
            if len(edges) > 1:
                yield found(t, list(zip(edges[:-1], edges[1:], strict=True)))
            held = [t.slice(edges[-1])]  # the last trace may go on
        if held:
            t = pa.concat_tables(held)
            yield found(t, [(0, t.num_rows)])

    return rows.repartition("trace_id").sortWithinPartitions("trace_id").mapInArrow(run, schema)


def path_stats(paths: DataFrame) -> DataFrame:
    """total, self time (what a span adds beyond the next one), wait, pattern and length."""
    nxt = F.concat(F.slice("durations", F.lit(2), F.size("durations")), F.array(F.lit(0.0)))
    own = F.aggregate(F.zip_with("durations", nxt, lambda a, b: F.greatest(F.lit(0.0), a - b)), F.lit(0.0), lambda a, x: a + x)
    pattern = F.array_join(F.zip_with("services", "operations", lambda s, o: F.concat_ws(":", s, o)), " -> ")
    out = paths.withColumn("total_ms", F.aggregate("durations", F.lit(0.0), lambda a, x: a + x)).withColumn("self_ms", own)
    return out.select("trace_id", "total_ms", "self_ms", (F.col("total_ms") - F.col("self_ms")).alias("wait_ms"), F.size("path").alias("length"), pattern.alias("pattern"), "services", "operations", "durations")


def path_summary(stats: DataFrame) -> DataFrame:
    """Mean, p50/95/99 (nearest rank), mean length, commonest pattern and its share. Paths are found once and read four times."""
    stats = cut_lineage(stats.select("pattern", "total_ms", "length"))
    top = stats.groupBy("pattern").agg(F.count("*").alias("c")).agg(F.max_by("pattern", F.struct("c", F.col("pattern"))).alias("pattern"), F.max("c").alias("c"), F.sum("c").alias("n"))
    base = stats.agg(F.avg("total_ms").alias("avg"), F.avg("length").alias("mean_length"))
    ranks = rank_percentiles(stats, [], "total_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return base.crossJoin(ranks).crossJoin(top.select("pattern", ratio(F.col("c"), F.col("n")).alias("pattern_share")))


def path_bottlenecks(stats: DataFrame, dimension: str = "service", n: int = 10) -> DataFrame:
    """(0.5 avg + 0.3 p95) ln(frequency + 1) by service or by operation, with its share of all path time."""
    zipped = stats.select(F.explode(F.arrays_zip("services", "operations", "durations")).alias("s"))
    key = F.col("s.services") if dimension == "service" else F.concat_ws(":", F.col("s.services"), F.col("s.operations"))
    rows = zipped.select(key.alias(dimension), F.col("s.durations").alias("ms"))
    base = rows.groupBy(dimension).agg(F.avg("ms").alias("avg"), F.count("*").alias("frequency"), F.sum("ms").alias("sum"))
    out = base.join(rank_percentiles(rows, [dimension], "ms", {"p95": 0.95}), dimension)
    whole = F.broadcast(rows.agg(F.sum("ms").alias("_all")))
    out = out.crossJoin(whole).withColumn("score", (F.col("avg") * 0.5 + F.col("p95") * 0.3) * F.log(F.col("frequency") + 1)).withColumn("contribution", percent(F.col("sum"), F.col("_all")))
    return out.select(dimension, "avg", "p95", "frequency", "score", "contribution").orderBy(F.desc("score"), dimension).limit(n)


def savings(bottlenecks: DataFrame, dimension: str = "service") -> DataFrame:
    """30 % for services, 40 % for operations; effort by size and return = contribution / effort."""
    part = 0.3 if dimension == "service" else 0.4
    effort = F.when(F.col("avg") > 1000, 3).when(F.col("avg") > 500, 2).otherwise(1)
    return bottlenecks.select(dimension, (F.col("avg") * part).alias("saving_ms"), effort.alias("effort"), (F.col("contribution") / effort).alias("roi"))


def error_chains(spans: DataFrame, direction: str = "upstream", max_depth: int | None = None) -> DataFrame:
    """From each error span, its chain of erroring parents (upstream) or the erroring spans below it (downstream).

    A row per chain of at least two spans: origin, path of services from the origin on, types
    and depth. Downstream lists the reachable error spans by (depth, start, id).
    """
    e = cut_lineage(spans.filter("is_error").select("trace_id", "span_id", "parent_span_id", "service", "error_type", "start_ts"))
    up = direction == "upstream"
    links = e if up else e.filter("parent_span_id <> span_id")
    here, there = ("span_id", "parent_span_id") if up else ("parent_span_id", "span_id")
    step = links.select("trace_id", F.col(here).alias("_s"), F.col(there).alias("_next"), F.col("span_id").alias("_m"), F.col("service").alias("_v"), F.col("error_type").alias("_t"), F.col("start_ts").alias("_ts"))
    first = e.select(
        "trace_id", F.col("span_id").alias("origin"), F.lit(0).alias("depth"), F.col("start_ts").alias("ts"), F.col("span_id").alias("member"), "service", "error_type",
        F.col("parent_span_id" if up else "span_id").alias("at"), F.array("span_id").alias("_seen"),
    )

    def following(level: DataFrame) -> DataFrame:
        near = level.select("trace_id", "origin", "depth", F.col("at").alias("_s"), "_seen").join(step, ["trace_id", "_s"]).filter(~F.array_contains("_seen", F.col("_m")))
        return near.select(
            "trace_id", "origin", (F.col("depth") + 1).alias("depth"), F.col("_ts").alias("ts"), F.col("_m").alias("member"), F.col("_v").alias("service"), F.col("_t").alias("error_type"),
            F.col("_next").alias("at"), F.concat("_seen", F.array("_m")).alias("_seen"),
        )

    out = _levels(first, following, max_depth)
    chains = out.groupBy("trace_id", "origin").agg(F.sort_array(F.collect_list(F.struct("depth", "ts", "member", "service", "error_type"))).alias("c"))
    return chains.filter(F.size("c") > 1).select("trace_id", "origin", F.transform("c", lambda x: x["service"]).alias("services"), F.array_distinct(F.filter(F.transform("c", lambda x: x["error_type"]), lambda t: t.isNotNull())).alias("types"), F.size("c").alias("length"), F.transform("c", lambda x: x["ts"]).alias("times"))


def classify_chains(chains: DataFrame) -> DataFrame:
    """circular (a service repeats), cascade (over 3 spans) or simple; propagation time; whether the type changes."""
    kind = F.when(F.size(F.array_distinct("services")) < F.size("services"), "circular").when(F.col("length") > 3, "cascade").otherwise("simple")
    spread = (F.unix_micros(F.array_max("times").cast("timestamp")) - F.unix_micros(F.array_min("times").cast("timestamp"))) / 1000.0
    return chains.select("trace_id", "origin", F.array_join("services", " -> ").alias("pattern"), "length", kind.alias("kind"), spread.alias("propagation_ms"), (F.size("types") > 1).alias("transformed"), F.element_at("services", 1).alias("source"))


def consolidate_chains(classified: DataFrame) -> DataFrame:
    return classified.groupBy("pattern", "kind").agg(F.count("*").alias("occurrences"), F.avg("propagation_ms").alias("mean_ms"), F.max("length").alias("depth"), F.count_if("transformed").alias("transformed"))


def error_sources(classified: DataFrame) -> DataFrame:
    """Occurrences per source service, its share in %, the first three primary and the next seven secondary."""
    per = classified.groupBy("source").agg(F.count("*").alias("occurrences"))
    whole = F.broadcast(per.agg(F.sum("occurrences").alias("_all")))
    ranked = per.crossJoin(whole).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("occurrences"), "source")).cast("long"))
    return ranked.filter("rank <= 10").select("source", "occurrences", percent(F.col("occurrences"), F.col("_all")).alias("share"), F.when(F.col("rank") <= 3, "primary").otherwise("secondary").alias("role"))


def error_impact(classified: DataFrame) -> DataFrame:
    """One row: affected services, amplification, cascade risk and score."""
    services = classified.select(F.explode(F.split("pattern", " -> ")).alias("s")).agg(F.count_distinct("s").alias("services"))
    base = classified.agg(F.avg("length").alias("amplification"), F.max("length").alias("max_amplification"), F.count_if(F.col("kind") == "cascade").alias("cascades"))
    risk = F.when(F.col("cascades") > 10, "high").when(F.col("cascades") > 5, "medium").otherwise("low")
    return services.crossJoin(base).withColumn("risk", risk).withColumn("score", F.least(F.lit(100.0), F.col("services") * 10 + F.col("amplification") * 5 + F.col("cascades") * 2))


def cascade_severity(consolidated: DataFrame) -> DataFrame:
    services = F.size(F.array_distinct(F.split("pattern", " -> ")))
    score = F.col("depth") * 10 + services * 5 + F.least(F.col("occurrences") * 2, F.lit(20)) + F.when(F.col("transformed") > 0, 10).otherwise(0)
    return consolidated.withColumn("severity", score)


def dependency_errors(spans: DataFrame) -> DataFrame:
    """Erroring children of erroring parents by service pair, with their types."""
    p = spans.filter("is_error").select("trace_id", F.col("span_id").alias("_p"), F.col("service").alias("parent"))
    c = spans.filter("is_error").select("trace_id", F.col("parent_span_id").alias("_p"), F.col("service").alias("child"), "error_type")
    return c.join(p, ["trace_id", "_p"]).groupBy("parent", "child").agg(F.count("*").alias("errors"), F.sort_array(F.collect_set("error_type")).alias("types"))
