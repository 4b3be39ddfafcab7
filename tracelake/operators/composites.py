"""Whole analyses made of the single operators: dependency, service, span, attribute and series reports, clustering inputs and outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.functions import predicates as P
from tracelake.functions.lineage import cut_lineage
from tracelake.functions.stats import rank_percentiles, ratio
from tracelake.operators import anomaly as X
from tracelake.operators import graph as G
from tracelake.operators import series as R
from tracelake.operators import spans as N

# services -----------------------------------------------------------------------------------


def paths_through(paths: DataFrame) -> DataFrame:
    """service and the number of service paths that it lies on."""
    return paths.select(F.explode("path").alias("service")).groupBy("service").agg(F.count("*").alias("paths"))


def dependency_report(spans: DataFrame, max_len: int = 5) -> DataFrame:
    """A row per service: requests, mean duration, error rate, who calls it and whom it calls, paths through it and health."""
    edges, nodes = G.dependency_edges(spans), G.service_nodes(spans)
    sides = G.service_rollup(edges).select("service", F.col("dependents").alias("upstream"), F.col("dependencies").alias("downstream"))
    none = F.array().cast("array<string>")
    out = nodes.join(sides, "service", "left").join(paths_through(G.service_paths(edges, max_len)), "service", "left").join(G.service_health(nodes, edges), "service", "left")
    return out.select("service", "requests", "avg", "error_rate", F.coalesce("upstream", none).alias("upstream"), F.coalesce("downstream", none).alias("downstream"), F.coalesce("paths", F.lit(0)).alias("paths"), "health")


def bottleneck_services(report: DataFrame, least: float = 0.5) -> DataFrame:
    """Services of ``dependency_report`` whose fan-in, latency, errors and paths score above ``least``, with their loads."""
    score = F.least(F.size("upstream") / 10.0, F.lit(1.0)) * 0.3 + F.least(F.col("avg") / 5000.0, F.lit(1.0)) * 0.3 + F.col("error_rate") * 0.2 + F.least(F.col("paths") / 10.0, F.lit(1.0)) * 0.2
    out = report.withColumn("score", score).filter(F.col("score") > least)
    return out.select("service", "score", (F.size("upstream") * F.col("requests")).alias("incoming_load"), (F.size("downstream") * F.col("requests")).alias("outgoing_load"), "avg", "error_rate", "paths")


def service_graph(spans: DataFrame) -> DataFrame:
    """A row per node: requests, mean duration, error rate, degree, its component and the cohesion of that."""
    edges, nodes = G.dependency_edges(spans), G.service_nodes(spans)
    labels = G.components(edges)
    groups = G.cohesion(edges, labels).select("label", "size", "cohesion")
    return nodes.join(labels, "service", "left").join(groups, "label", "left").join(G.centrality(edges).select("service", "degree"), "service", "left").select("service", "requests", "avg", "error_rate", F.coalesce("degree", F.lit(0.0)).alias("degree"), F.col("label").alias("cluster"), "size", "cohesion")


def _first_traces(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` trace ids of each group; Spark cuts each task's ranks before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy("trace_id")
    few = rows.select(*keys, "trace_id").distinct().withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list("trace_id")).alias("trace_ids"))


def traced_graph(spans: DataFrame, traces: int = 10) -> DataFrame:
    """Nodes and edges (target null for nodes): count, errors, error rate, mean, p95 by floor rank, traces and the first ids."""
    nodes = spans.select(F.col("service").alias("source"), F.lit(None).cast("string").alias("target"), "trace_id", "duration_ms", "is_error")
    rows = nodes.unionByName(G.calls(spans).select("source", "target", "trace_id", "duration_ms", "is_error")).withColumn("target", F.coalesce("target", F.lit("")))
    keys = ["source", "target"]
    # a row a trace of each edge, written once: totals, distinct traces and first ids come from it
    sums = [F.count("*").alias("_n"), F.count_if("is_error").alias("_e"), F.sum("duration_ms").alias("_ms"), F.count("duration_ms").alias("_known")]
    per = cut_lineage(rows.groupBy(*keys, "trace_id").agg(*sums))
    base = per.groupBy(*keys).agg(F.sum("_n").alias("count"), F.sum("_e").alias("errors"), F.try_divide(F.sum("_ms"), F.sum("_known")).alias("avg"), F.count("trace_id").alias("traces"))
    out = base.join(rank_percentiles(rows, keys, "duration_ms", {"p95": 0.95}, "floor"), keys).join(_first_traces(per, keys, traces), keys)
    return out.select("source", F.nullif("target", F.lit("")).alias("target"), "count", "errors", ratio(F.col("errors"), F.col("count")).alias("error_rate"), "avg", "p95", "traces", "trace_ids")


def edge_outliers(spans: DataFrame, least_calls: int = 5, method: str = "robust", t: float = 3.5, traces: int = 10) -> DataFrame:
    """Edges of at least ``least_calls`` calls that stand out by error rate, mean and p95, with their kind and first trace ids."""
    edges = cut_lineage(traced_graph(spans, traces).filter(F.col("target").isNotNull() & (F.col("count") >= least_calls)))
    scored = X.outlier_scores(edges, ["error_rate", "avg", "p95"], method=method) if method != "robust" else X.robust_scores(edges, ["error_rate", "avg", "p95"], least=1)
    kind = F.when(F.col("error_rate") > 0.1, "high_error_rate").when(F.col("p95") > 1000, "high_latency").otherwise("unusual_pattern")
    return scored.filter(F.col("score") > t).withColumn("kind", kind)


def unusual_changes(changes: DataFrame, method: str = "robust", t: float | None = None) -> DataFrame:
    """Changes from ``graph.edge_changes`` that stand out among all: by their kind and deltas (beyond 3.5), or (``text``) by their wording's similarity to the centroid (below .7)."""
    if method == "text":
        from tracelake.operators.vectors import centroid_outliers, embed_column

        return centroid_outliers(embed_column(G.change_text(changes), "text"), "embedding", 0.7 if t is None else t)
    kinds = {f"_{k}": (F.col("kind") == k).cast("double") for k in ("new", "removed", "traffic_change", "error_rate_change")}
    deltas = {"_difference": F.col("difference").cast("double"), "_change": F.coalesce("change", F.lit(0.0)), "_error_change": F.coalesce("error_change", F.lit(0.0))}
    rows, features = changes.withColumns(kinds | deltas), [*kinds, *deltas]
    scored = X.robust_scores(rows, features, least=1) if method == "robust" else X.outlier_scores(rows, features, method=method)
    return scored.filter(F.col("score") > (3.5 if t is None else t)).drop(*features)


# spans and attributes -----------------------------------------------------------------------


def chosen_spans(spans: DataFrame, service: str | None = None, operation: str | None = None, least_ms: float | None = None, errors_only: bool = False) -> DataFrame:
    """Spans of a service (exact, wildcard or part), an operation, from a duration on, or in error."""
    rows = spans if service is None else spans.filter(P.service_filter(F.col("service"), service))
    rows = rows if operation is None else rows.filter(F.col("operation") == operation)
    rows = rows if least_ms is None else rows.filter(F.col("duration_ms") >= least_ms)
    return rows.filter("is_error") if errors_only else rows


def span_report(spans: DataFrame, **chosen) -> DataFrame:
    """Sections ``overall``, ``operation`` (one a row) and ``bottleneck`` (by reason) of the chosen spans: name, count, avg, p95, error_rate."""
    rows = chosen_spans(spans, **chosen)
    columns = ("count", "avg", "p95", "error_rate")
    whole = N.span_stats(rows).select(F.lit("overall").alias("section"), F.lit("all").alias("name"), *columns)
    each = N.span_stats(rows, ["service", "operation"]).select(F.lit("operation").alias("section"), F.concat_ws(":", "service", "operation").alias("name"), *columns)
    slow = N.span_bottlenecks(rows).groupBy("reasons").agg(F.count("*").alias("count"), F.avg("duration_ms").alias("avg"))
    none = F.lit(None).cast("double")
    return whole.unionByName(each).unionByName(slow.select(F.lit("bottleneck").alias("section"), F.col("reasons").alias("name"), "count", "avg", none.alias("p95"), none.alias("error_rate")))


def attribute_report(df: DataFrame, attributes: str = "attributes", n: int = 10) -> DataFrame:
    """Sections ``value`` (the ``n`` commonest of each key) and ``keys`` (key sets) of the spans' attributes: name, value, count."""
    values = N.common_attributes(df, attributes, n).select(F.lit("value").alias("section"), F.col("key").alias("name"), "value", "count")
    sets = N.attribute_patterns(df, attributes).select(F.lit("keys").alias("section"), F.col("pattern").alias("name"), F.lit(None).cast("string").alias("value"), "count")
    return values.unionByName(sets)


def attribute_text_profile(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Per key: values, different values, their sentiments, and how often each kind of entity stands in them."""
    rows = df.select(F.explode(attributes).alias("key", "value")).filter(F.col("value").isNotNull())
    mood = C.sentiment(C.sentiment_score(F.col("value"), F.lit("info")))
    found = {n: F.sum(F.regexp_count("value", F.lit(p))).alias(n.lower()) for n, p in C.ENTITIES.items()}
    return rows.groupBy("key").agg(
        F.count("*").alias("count"), F.count_distinct("value").alias("unique_values"), F.count_if(mood == "positive").alias("positive"),
        F.count_if(mood == "neutral").alias("neutral"), F.count_if(mood == "negative").alias("negative"), *found.values(),
    )


def attribute_text_categories(df: DataFrame, rules: Mapping[str, Sequence[str]], attributes: str = "attributes") -> DataFrame:
    """Per key and label: values, their share of the key's and the mean score.

    A value's label is the rule with most of its words in the value, the first of ties, ``other``
    without any; its score is that rule's part of all hits.
    """
    text = F.lower("value")
    hits = F.array(*[F.struct(_hits(text, words).alias("n"), F.lit(-i).alias("first"), F.lit(label).alias("label")) for i, (label, words) in enumerate(rules.items())])
    rows = df.select(F.explode(attributes).alias("key", "value")).filter(F.col("value").isNotNull()).select("key", hits.alias("hits"))
    best, total = F.array_max("hits"), F.aggregate("hits", F.lit(0), lambda a, x: a + x["n"])
    rows = rows.select("key", F.when(total > 0, best["label"]).otherwise("other").alias("label"), ratio(best["n"], total).alias("score"))
    out = rows.groupBy("key", "label").agg(F.count("*").alias("count"), F.avg("score").alias("mean_score"))
    return out.withColumn("share", ratio(F.col("count"), F.sum("count").over(Window.partitionBy("key"))))


def _hits(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


# series -------------------------------------------------------------------------------------


def series_report(series: DataFrame, keys: Sequence[str], fill: str = "interpolate", window: int = 5, parts: Sequence[str] = ("statistics", "trend", "seasonality", "changes", "anomalies")) -> DataFrame:
    """A row per series, filled and smoothed: the parts that are asked for, side by side."""
    rows = R.fill_missing(series, keys, fill)
    out = rows.groupBy(*keys).agg(F.count("*").alias("points"))
    if "statistics" in parts:
        out = out.join(R.statistics(rows, keys), list(keys), "left")
    if "trend" in parts:
        smooth = R.smooth(rows, keys, "sma", window).withColumn("value", F.col("smooth"))
        out = out.join(R.trend(smooth, keys).select(*keys, "slope", "r2", "direction"), list(keys), "left")
    if "seasonality" in parts:
        best = R.seasonality(rows, keys).groupBy(*keys).agg(F.max(F.struct("amplitude", (-F.col("period")).alias("p"))).alias("b"))
        out = out.join(best.select(*keys, (-F.col("b.p")).alias("period"), F.col("b.amplitude").alias("amplitude")), list(keys), "left")
    if "changes" in parts:
        out = out.join(R.change_points(rows, keys).groupBy(*keys).agg(F.count("*").alias("changes")), list(keys), "left").fillna(0, ["changes"])
    if "anomalies" in parts:
        out = out.join(X.rolling_anomalies(rows, keys).groupBy(*keys).agg(F.count("*").alias("anomalies")), list(keys), "left").fillna(0, ["anomalies"])
    return out


def range_histogram(df: DataFrame, value: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Buckets of a width with their counts, shares and the mean of what is in them, per key."""
    rows = df.withColumn("bucket", F.floor(F.col(value) / width) * width)
    out = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("count"), F.avg(value).alias("mean"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return out.withColumn("share", ratio(F.col("count"), F.sum("count").over(whole)))


def banded(forecast: DataFrame, band: float = 0.1) -> DataFrame:
    """A forecast with a band of ±``band`` of its value where it has none."""
    lower, upper = (F.col(c) if c in forecast.columns else F.lit(None).cast("double") for c in ("lower", "upper"))
    return forecast.withColumns({"lower": F.coalesce(lower, F.col("forecast") - F.abs("forecast") * band), "upper": F.coalesce(upper, F.col("forecast") + F.abs("forecast") * band)})


def analyse_signal(series: DataFrame, keys: Sequence[str], action: str, periods: int = 7, **more) -> DataFrame:
    """``anomaly`` (rows with their score, flagged above 0.7), ``forecast`` (with a band) or ``pattern`` (trend and strongest season) of any signal that is a series."""
    if action == "forecast":
        return banded(R.forecast(series, keys, periods, **more))
    if action == "anomaly":
        return X.detect_anomalies(series, keys, **more).withColumn("is_anomaly", F.col("score") > 0.7)
    if action == "pattern":
        best = R.seasonality(series, keys, more.get("seasons", (24, 7, 30))).groupBy(*keys).agg(F.max_by("period", F.struct("amplitude", -F.col("period"))).alias("period"), F.max("amplitude").alias("amplitude"))
        return R.trend(series, keys).select(*keys, "slope", "r2", "direction").join(best, list(keys))
    raise ValueError(action)


# severities and clusters --------------------------------------------------------------------


def severity_counts(df: DataFrame, severity: Column, keys: Sequence[str] = ()) -> DataFrame:
    """critical, high, medium and low rows, overall or per key."""
    name = F.lower(severity)
    return df.groupBy(*keys).agg(*[F.count_if(name == s).alias(s) for s in ("critical", "high", "medium", "low")])


def impact_class(z: Column) -> Column:
    """The class of a deviation by how many std it is away."""
    a = F.abs(z)
    return F.when(a > 5, "critical").when(a > 4, "high").when(a > 3, "medium").otherwise("low")


def cluster_input(spans: DataFrame, start=None, end=None, attribute: str | None = None, service: str | None = None, text: str | None = None) -> DataFrame:
    """Spans within a time range, with an attribute, of a service (wildcards), and with a text in their operation."""
    rows = spans
    if start is not None:
        rows = rows.filter(F.col("start_ts") >= start)
    if end is not None:
        rows = rows.filter(F.col("start_ts") <= end)
    if attribute is not None:
        rows = rows.filter(F.col(attribute).isNotNull())
    if service is not None:
        rows = rows.filter(P.service_filter(F.col("service"), service))
    if text is not None:
        rows = rows.filter(F.contains(F.lower("operation"), F.lit(text.lower())))
    return rows


def cluster_table(clustered: DataFrame, key: str, label: Column, cluster: str = "cluster", examples: int = 3) -> DataFrame:
    """A row per cluster (null: outliers): size, share, its commonest label and the first members; vectors stay out."""
    rows = clustered.select(F.col(cluster).alias("cluster"), F.col(key).alias("_key"), label.alias("_label"))
    per = rows.groupBy("cluster", "_label").agg(F.count("*").alias("_n"))
    name = per.groupBy("cluster").agg(F.min(F.struct((-F.col("_n")).alias("n"), "_label")).alias("b"), F.sum("_n").alias("size"))
    order = Window.partitionBy("cluster").orderBy("_key")
    first = rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= examples).groupBy("cluster").agg(F.sort_array(F.collect_list("_key")).alias("examples"))
    whole = F.broadcast(rows.agg(F.count("*").alias("_all")))
    out = name.join(first.withColumnRenamed("cluster", "_c"), F.col("cluster").eqNullSafe(F.col("_c"))).crossJoin(whole)
    return out.select("cluster", "size", ratio(F.col("size"), F.col("_all")).alias("share"), F.col("b._label").alias("label"), "examples", F.col("cluster").isNull().alias("is_outlier"))
