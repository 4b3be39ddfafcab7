"""Service-graph operators: edges, roll-ups, changes, centrality, components, paths, evolution.

Graphs are edge DataFrames (source, target, ...). Iterative operators are joins with a bound on
their rounds; their state is one row a node or a node pair.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.lineage import cut_lineage
from tracelake.functions.stats import percent, rank_percentiles, ratio
from tracelake.functions.timeutil import bucket


def calls(spans: DataFrame, root_edges: bool = True) -> DataFrame:
    """Child spans with their parent's service: source, target, and the child's columns."""
    p = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("source"), F.col("parent_span_id").alias("_pp"))
    c = spans.filter(F.col("parent_span_id").isNotNull()).withColumnRenamed("service", "target")
    out = c.join(p, ["trace_id", "parent_span_id"]).filter((F.col("source") != F.col("target")) & (F.col("source") != "unknown") & (F.col("target") != "unknown"))
    return (out if root_edges else out.filter(F.col("_pp").isNotNull())).drop("_pp")


def links(spans: DataFrame) -> DataFrame:
    """Distinct (source, target) of the calls, for what needs neither counts nor latencies; ids and services are derived once, children and parents read them."""
    ids = cut_lineage(spans.select("trace_id", "span_id", "parent_span_id", "service"))
    return cut_lineage(calls(ids).select("source", "target").distinct())


def dependency_edges(spans: DataFrame, minutes: float | None = None, root_edges: bool = True) -> DataFrame:
    """Per (source, target): calls, errors, rates in %, latency over positive durations with floor-rank percentiles, calls a minute."""
    rows = calls(spans, root_edges).withColumn("_ms", F.when(F.col("duration_ms") > 0, F.col("duration_ms")))
    # calls of equal latency are counted, and what follows reads the counts, as often as edges are used
    counts = cut_lineage(rows.groupBy("source", "target", "_ms").agg(F.count("*").alias("_n"), F.count_if("is_error").alias("_e")))
    mean = F.sum(F.col("_ms") * F.col("_n")) / F.sum(F.when(F.col("_ms").isNotNull(), F.col("_n")))
    base = counts.groupBy("source", "target").agg(F.sum("_n").alias("call_count"), F.sum("_e").alias("error_count"), mean.alias("lat_avg"), F.min("_ms").alias("lat_min"), F.max("_ms").alias("lat_max"))
    ranks = rank_percentiles(counts, ["source", "target"], "_ms", {"lat_p50": 0.5, "lat_p95": 0.95, "lat_p99": 0.99}, "floor", counted=True)
    out = base.join(ranks, ["source", "target"], "left").withColumn("error_rate", percent(F.col("error_count"), F.col("call_count")))
    out = out.withColumn("success_rate", 100 - F.col("error_rate"))
    return out.withColumn("throughput_per_min", F.col("call_count") / minutes) if minutes else out


def enhanced_edges(spans: DataFrame) -> DataFrame:
    """Nearest-rank percentiles, throughput between first and last trace start, criticality by calls a trace and errors."""
    rows = calls(spans)
    base = rows.groupBy("source", "target").agg(F.count("*").alias("call_count"), ratio(F.count_if("is_error"), F.count("*")).alias("error_rate"), F.avg("duration_ms").alias("lat_avg"))
    out = base.join(rank_percentiles(rows, ["source", "target"], "duration_ms", {"lat_p50": 0.5, "lat_p95": 0.95}), ["source", "target"])
    seconds = (F.unix_micros(F.max("start_ts").cast("timestamp")) - F.unix_micros(F.min("start_ts").cast("timestamp"))) / 1e6
    whole = F.broadcast(spans.agg(F.count_distinct("trace_id").alias("_traces"), seconds.alias("_seconds")))
    critical = F.least(ratio(F.col("call_count"), F.col("_traces")) + ratio(F.col("error_rate") * F.col("call_count"), F.lit(100)), F.lit(1.0))
    return out.crossJoin(whole).select(*out.columns, ratio(F.col("call_count"), F.col("_seconds")).alias("throughput"), critical.alias("criticality"))


def ends(edges: DataFrame) -> DataFrame:
    """Two rows an edge: service, other, side (out or in), calls and latency."""
    out = edges.select(F.col("source").alias("service"), F.col("target").alias("other"), F.lit("out").alias("side"), "call_count", "error_count", "lat_avg")
    return out.unionByName(edges.select(F.col("target").alias("service"), F.col("source").alias("other"), F.lit("in").alias("side"), "call_count", "error_count", "lat_avg"))


def service_rollup(edges: DataFrame) -> DataFrame:
    """In and out calls, mean latencies, dependency and dependent lists, hub (over 5) and critical (over 3 dependents and slow)."""
    is_out = F.col("side") == "out"
    out = ends(edges).groupBy("service").agg(
        F.coalesce(F.sum(F.when(is_out, F.col("call_count"))), F.lit(0)).alias("out_calls"), F.coalesce(F.sum(F.when(~is_out, F.col("call_count"))), F.lit(0)).alias("in_calls"),
        F.coalesce(F.avg(F.when(is_out, F.col("lat_avg"))), F.lit(0.0)).alias("out_latency"), F.coalesce(F.avg(F.when(~is_out, F.col("lat_avg"))), F.lit(0.0)).alias("in_latency"),
        F.coalesce(F.sum(F.when(~is_out, F.col("error_count"))), F.lit(0)).alias("in_errors"),
        F.sort_array(F.collect_set(F.when(is_out, F.col("other")))).alias("dependencies"), F.sort_array(F.collect_set(F.when(~is_out, F.col("other")))).alias("dependents"),
    )
    return out.withColumn("is_hub", F.size("dependencies") + F.size("dependents") > 5).withColumn("is_critical", (F.size("dependents") > 3) & (F.col("in_latency") > 500)).withColumn("is_root", F.size("dependents") == 0)


def edge_overview(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.avg("call_count").alias("mean_calls"), F.avg("error_rate").alias("mean_error_rate"))


def service_nodes(spans: DataFrame) -> DataFrame:
    """Requests, mean duration, error rate and kind (by the rows' ``kind`` column where there is one)."""
    kind = F.first("kind", ignorenulls=True) if "kind" in spans.columns else F.lit("service")
    return spans.groupBy("service").agg(F.count("*").alias("requests"), F.avg("duration_ms").alias("avg"), ratio(F.count_if("is_error"), F.count("*")).alias("error_rate"), kind.alias("kind"))


def edge_changes(current: DataFrame, baseline: DataFrame, traffic: float = 0.25, errors: float = 0.05, least: int = 10) -> DataFrame:
    """new / removed / traffic_change / error_rate_change between two windows of edges, with severity."""
    c = current.select("source", "target", F.col("call_count").alias("c"), (F.col("error_rate") / 100).alias("ce"))
    b = baseline.select("source", "target", F.col("call_count").alias("b"), (F.col("error_rate") / 100).alias("be"))
    j = c.join(b, ["source", "target"], "full_outer").withColumn("change", ratio(F.col("c") - F.col("b"), F.col("b"))).withColumn("error_change", F.col("ce") - F.col("be"))
    kind = (
        F.when(F.col("b").isNull() & (F.col("c") >= least), "new").when(F.col("c").isNull() & (F.col("b") >= least), "removed")
        .when(F.col("b").isNotNull() & F.col("c").isNotNull() & (F.greatest("b", "c") >= least) & (F.abs("change") >= traffic), "traffic_change")
        .when(F.col("b").isNotNull() & F.col("c").isNotNull() & (F.greatest("b", "c") >= least) & (F.abs("error_change") >= errors), "error_rate_change")
    )
    size = F.abs(F.coalesce("c", F.lit(0)) - F.coalesce("b", F.lit(0)))
    severity = F.when(F.col("kind") == "removed", "high").when(F.col("kind") == "new", F.when(size > 100, "medium").otherwise("low")).when(F.col("kind") == "error_rate_change", F.when(F.abs("error_change") >= 0.1, "high").otherwise("medium")).otherwise(F.when(F.abs("change") >= 0.5, "medium").otherwise("low"))
    return j.withColumn("kind", kind).filter("kind is not null").withColumn("difference", size).withColumn("severity", severity).select("source", "target", "kind", "severity", "difference", "change", "error_change")


def change_text(changes: DataFrame) -> DataFrame:
    return changes.withColumn("text", F.format_string("%s from %s to %s severity %s difference %d", "kind", "source", "target", "severity", F.col("difference").cast("long")))


def edges_by_interval(spans: DataFrame, seconds: int) -> DataFrame:
    rows = calls(spans)
    return rows.groupBy(bucket(F.col("start_ts"), seconds).alias("bucket"), "source", "target").agg(F.count("*").alias("call_count"), percent(F.count_if("is_error"), F.count("*")).alias("error_rate"), F.avg("duration_ms").alias("lat_avg"))


def edge_changes_by_interval(spans: DataFrame, seconds: int, least: float = 0.2) -> DataFrame:
    """Between neighbouring intervals: new_edge, removed_edge, or the largest of traffic, error and latency change."""
    e = edges_by_interval(spans, seconds)
    steps = e.select("bucket").distinct().withColumn("i", F.row_number().over(Window.orderBy("bucket")))
    e = e.join(F.broadcast(steps), "bucket")
    now = e.select("i", "bucket", "source", "target", "call_count", "error_rate", "lat_avg")
    was = e.select((F.col("i") + 1).alias("i"), "source", "target", F.col("call_count").alias("bc"), F.col("error_rate").alias("be"), F.col("lat_avg").alias("bl"))
    j = now.join(was, ["i", "source", "target"], "full_outer").filter(F.col("i") > 1).join(F.broadcast(steps.select("i", F.col("bucket").alias("at"))), "i")
    rel = lambda a, b: F.abs(ratio(F.col(a) - F.col(b), F.col(b)))
    t, x, lat = rel("call_count", "bc"), F.abs(F.col("error_rate") - F.col("be")) / 100, rel("lat_avg", "bl")
    top = F.greatest(t, x, lat)
    kind = F.when(F.col("bc").isNull(), "new_edge").when(F.col("call_count").isNull(), "removed_edge").when(top < least, None).when(t == top, "traffic_change").when(x == top, "error_rate_change").otherwise("latency_change")
    return j.withColumn("kind", kind).filter("kind is not null").select("at", "source", "target", "kind")


def dependency_series(spans: DataFrame, seconds: int) -> DataFrame:
    """Per interval: edges, services, mean calls and error rate, complexity = edges / services."""
    e = edges_by_interval(spans, seconds)
    services = e.select("bucket", F.explode(F.array("source", "target")).alias("s")).groupBy("bucket").agg(F.count_distinct("s").alias("services"))
    out = e.groupBy("bucket").agg(F.count("*").alias("edges"), F.avg("call_count").alias("mean_calls"), F.avg("error_rate").alias("mean_error_rate"))
    return out.join(services, "bucket").withColumn("complexity", F.col("edges") / F.col("services"))


def volatile_services(spans: DataFrame, seconds: int, share: float = 0.8) -> DataFrame:
    """Services present in fewer than ``share`` of the intervals."""
    e = edges_by_interval(spans, seconds).select("bucket", F.explode(F.array("source", "target")).alias("service"))
    whole = F.broadcast(e.agg(F.count_distinct("bucket").alias("_all")))
    return e.groupBy("service").agg(F.count_distinct("bucket").alias("present")).crossJoin(whole).filter(F.col("present") < share * F.col("_all")).select("service", "present")


def dependency_anomalies(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """New and missing edges, latency up by half, error rate up by 10 points."""
    c = current.select("source", "target", F.col("lat_avg").alias("c"), F.col("error_rate").alias("ce"))
    b = baseline.select("source", "target", F.col("lat_avg").alias("b"), F.col("error_rate").alias("be"))
    kind = F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "missing").when(F.col("c") > 1.5 * F.col("b"), "latency").when(F.col("ce") - F.col("be") > 10, "errors")
    return c.join(b, ["source", "target"], "full_outer").withColumn("kind", kind).filter("kind is not null").select("source", "target", "kind")


def service_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """1 - (0.4 error rate + 0.3 min(avg/5000, 1) + 0.3 issues/10); issues: errors > 5 %, avg > 1 s, downstream errors > 10 %."""
    down = edges.groupBy(F.col("source").alias("service")).agg(F.max("error_rate").alias("_down"))
    issues = (F.col("error_rate") > 0.05).cast("int") + (F.col("avg") > 1000).cast("int") + (F.coalesce("_down", F.lit(0.0)) > 10).cast("int")
    health = 1 - (F.col("error_rate") * 0.4 + F.least(F.col("avg") / 5000, F.lit(1.0)) * 0.3 + issues / 10 * 0.3)
    return nodes.join(down, "service", "left").select("service", issues.alias("issues"), health.alias("health"))


def service_paths(edges: DataFrame, max_len: int = 5) -> DataFrame:
    """Simple paths from services without callers to a leaf or ``max_len`` nodes."""
    e = edges.select("source", "target").distinct()
    outs = e.select(F.col("source").alias("_leaf")).distinct()
    level = e.select(F.col("source").alias("at")).distinct().join(e.select(F.col("target").alias("at")).distinct(), "at", "left_anti").withColumn("path", F.array("at"))
    done = None
    for i in range(max_len):
        stop = level if i == max_len - 1 else level.join(outs, F.col("at") == F.col("_leaf"), "left_anti")
        done = stop.select("path") if done is None else done.unionByName(stop.select("path"))
        level = level.join(e, F.col("at") == F.col("source")).filter(~F.array_contains("path", F.col("target"))).select(F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path"))
    return done.filter(F.size("path") > 1)


def path_usage(paths: DataFrame, spans: DataFrame) -> DataFrame:
    """Traces that hold a path as an ordered subsequence of their services: count, mean duration, error share, criticality.

    Traces of the same services in the same order are one row. Each follows the paths from service
    to service, at the first place where the next one stands, so it meets only beginnings of paths
    that it holds; no path is compared with a trace that lacks it.
    """
    t = spans.groupBy("trace_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_ts", "span_id", "service"))), lambda x: x["service"]).alias("walk"), F.sum("duration_ms").alias("total"), F.max("is_error").alias("bad"))
    walks = cut_lineage(t.groupBy("walk").agg(F.count("*").alias("n"), F.sum("total").alias("sum"), F.count("total").alias("known"), F.count_if("bad").alias("bad")))
    whole = F.broadcast(walks.agg(F.sum("n").alias("_all")))
    paths = cut_lineage(paths.select("path").distinct())
    longest = paths.agg(F.max(F.size("path"))).first()[0] or 0
    measures = ("n", "sum", "known", "bad")
    # path and rest: what is followed so far, and the services after it
    level = walks.select(F.array().cast("array<string>").alias("path"), F.col("walk").alias("rest"), *measures)
    used = None
    for k in range(1, longest + 1):
        begun = cut_lineage(paths.filter(F.size("path") >= k).select(F.slice("path", 1, k).alias("path")).distinct())  # small ones go to every task
        following = level.withColumn("_s", F.explode(F.array_distinct("rest")))
        following = following.select(F.concat("path", F.array("_s")).alias("path"), F.expr("slice(rest, array_position(rest, _s) + 1, size(rest))").alias("rest"), *measures)
        level = following.join(begun, "path")
        ends = level.join(paths.filter(F.size("path") == k), "path", "left_semi").groupBy("path").agg(*[F.sum(m).alias(m) for m in measures])
        used = ends if used is None else used.unionByName(ends)
    if used is None:
        used = level.limit(0).drop("rest")
    out = used.select("path", F.col("n").alias("traces"), F.try_divide("sum", "known").alias("avg"), ratio(F.col("bad"), F.col("n")).alias("error_share"))
    return out.crossJoin(whole).withColumn("criticality", ratio(F.col("traces"), F.col("_all"))).drop("_all")


def topology_paths(edges: DataFrame, max_len: int = 6) -> DataFrame:
    """Paths of at least three services: summed latency, call-weighted error rate, bottleneck edges; the ten longest-lasting."""
    p = service_paths(edges, max_len).filter(F.size("path") >= 3).withColumn("id", F.array_join("path", ">"))
    hops = p.select("id", F.posexplode(F.slice("path", 2, max_len)).alias("i", "target"), "path").withColumn("source", F.element_at("path", F.col("i") + 1))
    e = edges.select("source", "target", "lat_avg", "error_rate", "call_count")
    slow = (F.col("lat_avg") > 500) | (F.col("error_rate") > 10)
    out = hops.join(e, ["source", "target"]).groupBy("id").agg(F.sum("lat_avg").alias("latency"), ratio(F.sum(F.col("error_rate") * F.col("call_count")), F.sum("call_count")).alias("error_rate"), F.count_if(slow).alias("bottlenecks"))
    return out.orderBy(F.desc("latency"), "id").limit(10)


def levels(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Breadth-first depth from services that nobody calls, down to the last that is reached or to ``max_depth`` levels."""
    e = cut_lineage(edges.select("source", "target").distinct())
    seen = e.select(F.col("source").alias("service")).distinct().join(e.select(F.col("target").alias("service")).distinct(), "service", "left_anti").withColumn("level", F.lit(0))
    for depth in range(1, max_depth) if max_depth else count(1):
        nxt = seen.filter(F.col("level") == depth - 1).join(e, F.col("service") == F.col("source")).select(F.col("target").alias("service")).distinct()
        nxt = nxt.join(seen.select("service"), "service", "left_anti")
        if nxt.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(nxt.withColumn("level", F.lit(depth))))
    return seen


def transitive(edges: DataFrame, service: str, depth: int = 3) -> DataFrame:
    """What a service depends on, directly or not: least depth and the service it goes through."""
    e = edges.select("source", "target").distinct()
    level = e.filter(F.col("source") == service).select(F.col("target").alias("service"), F.col("source").alias("via")).withColumn("depth", F.lit(1))
    out = level
    for d in range(2, depth + 1):
        level = level.select("service").distinct().join(e, F.col("service") == F.col("source")).filter(F.col("target") != service).select(F.col("target").alias("service"), F.col("source").alias("via")).distinct().withColumn("depth", F.lit(d))
        out = out.unionByName(level)
    first = out.groupBy("service").agg(F.min(F.struct("depth", "via")).alias("m"))
    return first.select("service", "m.depth", "m.via")


def centrality(edges: DataFrame) -> DataFrame:
    """Degree, simplified betweenness (share of edges that touch the node) and simplified eigenvector (incoming weight / n, at most 1)."""
    e = edges.select("source", "target", "call_count")
    both = e.select(F.col("source").alias("service"), F.lit(0).alias("w")).unionByName(e.select(F.col("target").alias("service"), F.col("call_count").alias("w")))
    per = both.groupBy("service").agg(F.count("*").alias("touching"), F.sum("w").alias("incoming"))
    whole = F.broadcast(per.agg(F.count("*").alias("n")).crossJoin(e.agg(F.count("*").alias("m"), F.sum("call_count").alias("calls"))))
    out = per.crossJoin(whole)
    return out.select("service", ratio(F.col("touching"), F.col("n") - 1).alias("degree"), ratio(F.col("touching"), F.col("m")).alias("betweenness"), F.least(ratio(F.col("incoming"), F.col("calls") * F.col("n")) * F.col("n"), F.lit(1.0)).alias("eigenvector"))


def shortest_hops(edges: DataFrame, undirected: bool = False, max_depth: int | None = None) -> DataFrame:
    """Unit distances between all node pairs that reach each other, or that do in fewer than ``max_depth`` steps: one join a level."""
    e = cut_lineage(edges.select("source", "target").distinct())
    if undirected:
        e = e.union(e.select("target", "source")).distinct()
    seen = e.filter("source <> target").withColumn("hops", F.lit(1))
    for d in range(2, max_depth) if max_depth else count(2):
        last = seen.filter(F.col("hops") == d - 1).select(F.col("source").alias("_s"), F.col("target").alias("_m"))
        nxt = last.join(e, F.col("_m") == F.col("source")).select(F.col("_s").alias("source"), "target").filter("source <> target").distinct()
        nxt = nxt.join(seen, ["source", "target"], "left_anti")
        if nxt.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(nxt.withColumn("hops", F.lit(d))))
    return seen


def closeness(edges: DataFrame) -> DataFrame:
    """Reachable nodes over the sum of their distances."""
    return shortest_hops(edges).groupBy(F.col("source").alias("service")).agg(ratio(F.count("*"), F.sum("hops")).alias("closeness"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Start 1/n, no redistribution from nodes without outgoing edges; lineage is cut every five rounds."""
    e = cut_lineage(edges.select("source", "target").distinct())
    nodes = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    n = nodes.count()
    out = e.groupBy("source").agg(F.count("*").alias("_out"))
    links = cut_lineage(e.join(out, "source"))
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        got = links.join(rank, F.col("source") == F.col("node")).groupBy("target").agg(F.sum(F.col("rank") / F.col("_out")).alias("_in"))
        rank = nodes.join(got, F.col("node") == F.col("target"), "left").select("node", ((1 - damping) / max(n, 1) + damping * F.coalesce("_in", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            rank = cut_lineage(rank)
    return rank.select(F.col("node").alias("service"), "rank")


def key_services(measures: DataFrame) -> DataFrame:
    """hub (degree > 0.5), bridge (betweenness > 0.3) and core (rank > 0.2) services."""
    roles = F.array_compact(F.array(F.when(F.col("degree") > 0.5, "hub"), F.when(F.col("betweenness") > 0.3, "bridge"), F.when(F.col("rank") > 0.2, "core")))
    return measures.withColumn("roles", F.array_join(roles, ",")).filter("roles <> ''")


def smallest_labels(both: DataFrame, rounds: int = 200) -> DataFrame:
    """node and label (the smallest node of its component) from edges (a, b) given in both directions.

    Each round every node takes the smallest label near it, then the label of that label, so
    rounds grow with the logarithm of a component's length.
    """
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = cut_lineage(labels)
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        step = cut_lineage(step.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("jump", "next")).alias("label")))
        labels = step.select("node", "label")
        if step.filter("was <> label").isEmpty():
            return labels
    raise RuntimeError(f"labels didn't settle in {rounds} rounds")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """service and the smallest service of its undirected component."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = cut_lineage(e.union(e.select("b", "a")).distinct())
    return smallest_labels(both, rounds).withColumnRenamed("node", "service")


def cohesion(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per group: size, cohesion = internal / n(n-1), coupling = external / touching, and what it suggests."""
    e = edges.select("source", "target").distinct()
    a = e.join(labels.select(F.col("service").alias("source"), F.col("label").alias("ls")), "source").join(labels.select(F.col("service").alias("target"), F.col("label").alias("lt")), "target")
    inner = a.filter("ls = lt").groupBy(F.col("ls").alias("label")).agg(F.count("*").alias("internal"))
    outer = a.filter("ls <> lt").select(F.explode(F.array("ls", "lt")).alias("label")).groupBy("label").agg(F.count("*").alias("external"))
    g = labels.groupBy("label").agg(F.count("*").alias("size")).join(inner, "label", "left").join(outer, "label", "left").fillna(0)
    g = g.withColumn("cohesion", ratio(F.col("internal"), F.col("size") * (F.col("size") - 1))).withColumn("coupling", ratio(F.col("external"), F.col("internal") + F.col("external")))
    return g.withColumn("suggestion", F.when((F.col("cohesion") < 0.3) & (F.col("size") > 3), "split").when(F.col("coupling") > 0.7, "extract"))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation in fixed rounds: the commonest label among neighbours, the smallest of ties."""
    e = edges.select("source", "target").distinct()
    both = cut_lineage(e.union(e.select("target", "source")))
    labels = both.select(F.col("source").alias("service")).distinct().withColumn("label", F.col("service"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("service").alias("target"), "label"), "target").groupBy(F.col("source").alias("service"), "label").agg(F.count("*").alias("n"))
        labels = cut_lineage(votes.groupBy("service").agg(F.min(F.struct(-F.col("n"), F.col("label").alias("l"))).alias("m")).select("service", F.col("m.l").alias("label")))
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Sum over groups of internal/m - (degree/2m)^2."""
    e = edges.select("source", "target").distinct()
    a = e.join(labels.select(F.col("service").alias("source"), F.col("label").alias("ls")), "source").join(labels.select(F.col("service").alias("target"), F.col("label").alias("lt")), "target")
    m = F.broadcast(a.agg(F.count("*").alias("m")))
    per = a.select(F.explode(F.array("ls", "lt")).alias("label"), (F.col("ls") == F.col("lt")).alias("inner")).groupBy("label").agg(F.count("*").alias("degree"), (F.count_if("inner") / 2).alias("internal"))
    return per.crossJoin(m).agg(F.sum(ratio(F.col("internal"), F.col("m")) - F.pow(ratio(F.col("degree"), F.col("m") * 2), F.lit(2))).alias("modularity"))


def graph_metrics(edges: DataFrame) -> DataFrame:
    """Nodes, edges, mean degree, density, the largest finite undirected distance."""
    e = edges.select("source", "target").distinct()
    n = e.select(F.explode(F.array("source", "target")).alias("s")).agg(F.count_distinct("s").alias("nodes"))
    d = shortest_hops(edges, undirected=True).agg(F.max("hops").alias("diameter"))
    out = n.crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(d)
    return out.select("nodes", "edges", ratio(F.col("edges") * 2, F.col("nodes")).alias("mean_degree"), ratio(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"), F.col("diameter").cast("int").alias("diameter"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """Per node: linked neighbour pairs over all neighbour pairs, undirected."""
    e = edges.select("source", "target").filter("source <> target").distinct()
    both = e.union(e.select("target", "source")).distinct()
    a = both.select(F.col("source").alias("service"), F.col("target").alias("x"))
    b = both.select(F.col("source").alias("service"), F.col("target").alias("y"))
    pairs = a.join(b, "service").filter("x < y").join(both.select(F.col("source").alias("x"), F.col("target").alias("y"), F.lit(1).alias("linked")), ["x", "y"], "left")
    return pairs.groupBy("service").agg(ratio(F.count("linked"), F.count("*")).alias("coefficient"))


def evolution(spans: DataFrame, seconds: int) -> DataFrame:
    """Per interval: nodes, edges, added and removed ones against the interval before, density and stability."""
    e = edges_by_interval(spans, seconds).select("bucket", "source", "target")
    steps = e.select("bucket").distinct().withColumn("i", F.row_number().over(Window.orderBy("bucket")))
    items = e.select("bucket", F.lit("edge").alias("what"), F.concat_ws(">", "source", "target").alias("id"))
    items = items.unionByName(e.select("bucket", F.lit("node").alias("what"), F.explode(F.array("source", "target")).alias("id")).distinct())
    items = items.join(F.broadcast(steps), "bucket").select("i", "what", "id")
    was = items.select((F.col("i") + 1).alias("i"), "what", "id", F.lit(True).alias("was"))
    j = items.withColumn("now", F.lit(True)).join(was, ["i", "what", "id"], "full_outer")
    is_ = lambda what, test: F.count_if((F.col("what") == what) & test)
    now, before = F.col("now").isNotNull(), F.col("was").isNotNull()
    per = j.groupBy("i").agg(is_("node", now).alias("nodes"), is_("edge", now).alias("edges"), is_("node", now & ~before).alias("added_nodes"), is_("edge", now & ~before).alias("added_edges"), is_("node", before & ~now).alias("removed_nodes"), is_("edge", before & ~now).alias("removed_edges"))
    out = per.join(F.broadcast(steps), "i").filter("nodes > 0")
    changes = F.col("added_nodes") + F.col("added_edges") + F.col("removed_nodes") + F.col("removed_edges")
    return out.select("bucket", "nodes", "edges", "added_nodes", "added_edges", "removed_nodes", "removed_edges", ratio(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"), (1 - F.least(ratio(changes, F.col("nodes") * 10), F.lit(1.0))).alias("stability"))


def hubs_and_single_points(edges: DataFrame, over: int = 3) -> DataFrame:
    """Services with over ``over`` targets (hub) or dependents (single point of failure)."""
    per = ends(edges).groupBy("service").agg(F.count_distinct(F.when(F.col("side") == "out", F.col("other"))).alias("targets"), F.count_distinct(F.when(F.col("side") == "in", F.col("other"))).alias("dependents"))
    return per.filter((F.col("targets") > over) | (F.col("dependents") > over)).withColumn("is_hub", F.col("targets") > over).withColumn("is_single_point", F.col("dependents") > over)


def similar_traces(paths: DataFrame, trace_id: str, least: float = 0.7) -> DataFrame:
    """Jaccard similarity of path signatures (trace_id, signature) with one trace's."""
    p = paths.select("trace_id", "signature").distinct()
    sizes = p.groupBy("trace_id").agg(F.count("*").alias("n"))
    mine = p.filter(F.col("trace_id") == trace_id).select("signature")
    own = F.broadcast(mine.agg(F.count("*").alias("m")))
    shared = p.filter(F.col("trace_id") != trace_id).join(F.broadcast(mine), "signature").groupBy("trace_id").agg(F.count("*").alias("both"))
    sim = ratio(F.col("both"), F.col("n") + F.col("m") - F.col("both"))
    return shared.join(sizes, "trace_id").crossJoin(own).select("trace_id", sim.alias("similarity")).filter(F.col("similarity") >= least)


def topology_score(edges: DataFrame) -> DataFrame:
    """100 less what mean errors, mean latency (200 / 500 / 1000 ms) and bottleneck edges cost."""
    m = edges.agg(F.avg("error_rate").alias("e"), F.avg("lat_avg").alias("l"), F.count_if((F.col("lat_avg") > 500) | (F.col("error_rate") > 10)).alias("b"))
    cost = F.least(F.col("e") * 2, F.lit(40.0)) + F.when(F.col("l") > 1000, 30).when(F.col("l") > 500, 20).when(F.col("l") > 200, 10).otherwise(0) + F.least(F.col("b") * 5, F.lit(30))
    return m.select(F.greatest(F.lit(0.0), 100 - cost).alias("score"))
