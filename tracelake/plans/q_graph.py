"""Service-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import graph as G
from tracelake.plans.fixtures import SPANS, spans
from tracelake.plans.registry import query

_CALLS = f"""{SPANS}, calls AS (SELECT c.*, p.service AS source, c.service AS target, p.parent_span_id IS NULL AS from_root FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.service <> c.service)"""
_EDGES = _CALLS + """, edges AS (SELECT source, target, count(*) AS call_count, count(*) FILTER (WHERE is_error) AS error_count, avg(duration_ms) AS lat_avg, count(*) FILTER (WHERE is_error) * 100.0 / count(*) AS error_rate FROM calls GROUP BY ALL)"""
_BOTH = _EDGES + ", both_ends AS (SELECT source AS service, target AS other, 'out' AS side, call_count, lat_avg FROM edges UNION ALL SELECT target, source, 'in', call_count, lat_avg FROM edges)"
_UND = _EDGES + ", und AS (SELECT source AS s, target AS t FROM edges UNION SELECT target, source FROM edges)"


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


def edges(spark, sf):
    return G.dependency_edges(spans(spark, sf))


def links(spark, sf):
    return G.links(spans(spark, sf))


_F = "list_sort(list(duration_ms) FILTER (WHERE duration_ms > 0))[least(CAST(floor({p} * count(*)) AS BIGINT) + 1, count(*))] AS {n}"
_G1 = ", ".join(_F.format(p=p, n=n) for p, n in ((0.5, "lat_p50"), (0.95, "lat_p95"), (0.99, "lat_p99")))


@query("g1_dependency_edges", f"WITH {_CALLS} SELECT source, target, count(*) AS call_count, count(*) FILTER (WHERE is_error) AS error_count, round(avg(duration_ms), 4) AS lat_avg, min(duration_ms) AS lat_min, max(duration_ms) AS lat_max, {_G1}, round(count(*) FILTER (WHERE is_error) * 100.0 / count(*), 4) AS error_rate, round(100 - count(*) FILTER (WHERE is_error) * 100.0 / count(*), 4) AS success_rate, round(count(*) / 1440.0, 4) AS throughput_per_min FROM calls GROUP BY ALL")
def _(spark, sf):
    return rounded(G.dependency_edges(spans(spark, sf), 1440.0), "lat_avg", "error_rate", "success_rate", "throughput_per_min")


@query("g2_edges_without_roots", f"WITH {_CALLS} SELECT source, target, count(*) AS call_count FROM calls WHERE NOT from_root GROUP BY ALL ORDER BY call_count DESC")
def _(spark, sf):
    return G.dependency_edges(spans(spark, sf), root_edges=False).select("source", "target", "call_count").orderBy(F.desc("call_count"))


@query("g3_enhanced_edges", f"WITH {_CALLS}, t AS (SELECT count(DISTINCT trace_id) AS n, (epoch_us(max(start_ts)) - epoch_us(min(start_ts))) / 1000000.0 AS s FROM spans) SELECT source, target, count(*) AS call_count, quantile_disc(duration_ms, 0.95) AS lat_p95, round(count(*) * 1000 / any_value(t.s), 6) AS per_ks, round(least(count(*) / CAST(any_value(t.n) AS DOUBLE) + avg(CAST(is_error AS INT)) * count(*) / 100, 1.0), 6) AS criticality FROM calls, t GROUP BY ALL")
def _(spark, sf):
    e = G.enhanced_edges(spans(spark, sf))
    return rounded(e.select("source", "target", "call_count", "lat_p95", (F.col("throughput") * 1000).alias("per_ks"), "criticality"), "per_ks", "criticality", digits=6)


@query("g4_service_rollup", f"WITH {_BOTH} SELECT service, CAST(coalesce(sum(call_count) FILTER (WHERE side = 'out'), 0) AS BIGINT) AS out_calls, CAST(coalesce(sum(call_count) FILTER (WHERE side = 'in'), 0) AS BIGINT) AS in_calls, round(coalesce(avg(lat_avg) FILTER (WHERE side = 'in'), 0), 4) AS in_latency, count(DISTINCT other) FILTER (WHERE side = 'out') AS n_out, count(DISTINCT other) FILTER (WHERE side = 'in') AS n_in, count(*) > 5 AS is_hub FROM both_ends GROUP BY service")
def _(spark, sf):
    r = G.service_rollup(edges(spark, sf))
    return rounded(r.select("service", "out_calls", "in_calls", "in_latency", F.size("dependencies").cast("long").alias("n_out"), F.size("dependents").cast("long").alias("n_in"), "is_hub"), "in_latency")


@query("g5_edge_overview", f"WITH {_EDGES} SELECT count(*) AS edges, round(avg(call_count), 4) AS mean_calls, round(avg(error_rate), 4) AS mean_error_rate FROM edges")
def _(spark, sf):
    return rounded(G.edge_overview(edges(spark, sf)), "mean_calls", "mean_error_rate")


@query("g6_service_nodes", f"WITH {SPANS} SELECT service, count(*) AS requests, round(avg(duration_ms), 4) AS avg, round(avg(CAST(is_error AS INT)), 6) AS error_rate, 'service' AS kind FROM spans GROUP BY service")
def _(spark, sf):
    return rounded(rounded(G.service_nodes(spans(spark, sf)), "avg"), "error_rate", digits=6)


_SPLIT = f"""WITH {_CALLS}, w AS (SELECT start_ts >= TIMESTAMP '1995-07-01 00:00:00' AS late, source, target, count(*) AS n, avg(CAST(is_error AS INT)) AS e, avg(duration_ms) AS l FROM calls WHERE line < 6 OR start_ts >= TIMESTAMP '1995-07-01 00:00:00' GROUP BY ALL), c AS (SELECT * FROM w WHERE late), b AS (SELECT * FROM w WHERE NOT late)"""


def halves(spark, sf):
    df = spans(spark, sf)
    late = F.col("start_ts") >= F.lit("1995-07-01 00:00:00").cast("timestamp_ntz")
    rows = G.calls(df).filter((F.col("line") < 6) | late)
    agg = lambda x: x.groupBy("source", "target").agg(F.count("*").alias("call_count"), (F.avg(F.col("is_error").cast("int")) * 100).alias("error_rate"), F.avg("duration_ms").alias("lat_avg"))
    return agg(rows.filter(late)), agg(rows.filter(~late))


@query("g35_cp6_edge_changes", _SPLIT + """, j AS (SELECT source, target, c.n AS c, b.n AS b, (c.n - b.n) / CAST(b.n AS DOUBLE) AS change, c.e - b.e AS error_change FROM c FULL OUTER JOIN b USING (source, target)),
k AS (SELECT *, CASE WHEN b IS NULL AND c >= 10 THEN 'new' WHEN c IS NULL AND b >= 10 THEN 'removed' WHEN b IS NOT NULL AND c IS NOT NULL AND greatest(b, c) >= 10 AND abs(change) >= 0.25 THEN 'traffic_change' WHEN b IS NOT NULL AND c IS NOT NULL AND greatest(b, c) >= 10 AND abs(error_change) >= 0.05 THEN 'error_rate_change' END AS kind FROM j)
SELECT source, target, kind, abs(coalesce(c, 0) - coalesce(b, 0)) AS difference FROM k WHERE kind IS NOT NULL""")
def _(spark, sf):
    return G.edge_changes(*halves(spark, sf)).select("source", "target", "kind", "difference")


@query("g39_dependency_anomalies", _SPLIT + """, k AS (SELECT source, target, CASE WHEN b.n IS NULL THEN 'new' WHEN c.n IS NULL THEN 'missing' WHEN c.l > 1.5 * b.l THEN 'latency' WHEN c.e - b.e > 0.1 THEN 'errors' END AS kind FROM c FULL OUTER JOIN b USING (source, target)) SELECT source, target, kind FROM k WHERE kind IS NOT NULL""")
def _(spark, sf):
    return G.dependency_anomalies(*halves(spark, sf))


@query("g37_interval_changes", f"""WITH {_CALLS}, e AS (SELECT time_bucket(INTERVAL '360 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS bucket, source, target, count(*) AS n, avg(CAST(is_error AS INT)) AS e, avg(duration_ms) AS l FROM calls GROUP BY ALL), s AS (SELECT bucket, row_number() OVER (ORDER BY bucket) AS i FROM (SELECT DISTINCT bucket FROM e)),
x AS (SELECT i, source, target, n, e, l FROM e JOIN s USING (bucket)), j AS (SELECT i, source, target, c.n, c.e, c.l, b.n AS bn, b.e AS be, b.l AS bl FROM x c FULL OUTER JOIN (SELECT i + 1 AS i, source, target, n, e, l FROM x) b USING (i, source, target)),
m AS (SELECT *, abs((n - bn) / CAST(bn AS DOUBLE)) AS t, abs(e - be) AS ee, abs((l - bl) / bl) AS ll FROM j JOIN s USING (i) WHERE i > 1)
SELECT bucket AS at, source, target, CASE WHEN bn IS NULL THEN 'new_edge' WHEN n IS NULL THEN 'removed_edge' WHEN t = greatest(t, ee, ll) THEN 'traffic_change' WHEN ee = greatest(t, ee, ll) THEN 'error_rate_change' ELSE 'latency_change' END AS kind FROM m WHERE bn IS NULL OR n IS NULL OR greatest(t, ee, ll) >= 0.2""")
def _(spark, sf):
    return G.edge_changes_by_interval(spans(spark, sf), 360 * 86400)


_MONTHS = f"WITH {_CALLS}, e AS (SELECT time_bucket(INTERVAL '360 days', start_ts, TIMESTAMP '1970-01-01 00:00:00') AS bucket, source, target, count(*) AS n, avg(CAST(is_error AS INT)) * 100 AS e FROM calls GROUP BY ALL), p AS (SELECT bucket, source AS s FROM e UNION SELECT bucket, target FROM e)"


@query("g38_dependency_series", _MONTHS + ", v AS (SELECT bucket, count(*) AS services FROM p GROUP BY bucket) SELECT e.bucket, count(*) AS edges, round(avg(n), 4) AS mean_calls, round(avg(e), 4) AS mean_error_rate, any_value(services) AS services, round(count(*) / CAST(any_value(services) AS DOUBLE), 4) AS complexity FROM e JOIN v ON v.bucket = e.bucket GROUP BY e.bucket")
def _(spark, sf):
    return rounded(G.dependency_series(spans(spark, sf), 360 * 86400), "mean_calls", "mean_error_rate", "complexity")


@query("g53_evolution", _MONTHS + """, s AS (SELECT bucket, row_number() OVER (ORDER BY bucket) AS i FROM (SELECT DISTINCT bucket FROM e)), n AS (SELECT bucket, count(*) AS nodes FROM p GROUP BY bucket), g AS (SELECT bucket, count(*) AS edges FROM e GROUP BY bucket),
a AS (SELECT s.bucket, count(*) AS added_edges FROM e JOIN s USING (bucket) WHERE NOT EXISTS (SELECT 1 FROM e o JOIN s t ON t.bucket = o.bucket WHERE t.i = s.i - 1 AND o.source = e.source AND o.target = e.target) GROUP BY 1)
SELECT n.bucket, nodes, edges, coalesce(added_edges, 0) AS added_edges, round(edges / CAST(nodes * (nodes - 1) AS DOUBLE), 4) AS density FROM n JOIN g USING (bucket) LEFT JOIN a USING (bucket)""")
def _(spark, sf):
    return rounded(G.evolution(spans(spark, sf), 360 * 86400).select("bucket", "nodes", "edges", "added_edges", "density"), "density")


@query("g41_service_health", f"""WITH {_EDGES}, n AS (SELECT service, avg(duration_ms) AS a, avg(CAST(is_error AS INT)) AS e FROM spans GROUP BY service), d AS (SELECT source AS service, max(error_rate) AS d FROM edges GROUP BY source), i AS (SELECT service, a, e, CAST(e > 0.05 AS INT) + CAST(a > 1000 AS INT) + CAST(coalesce(d, 0) > 10 AS INT) AS issues FROM n LEFT JOIN d USING (service))
SELECT service, issues, round(1 - (0.4 * e + 0.3 * least(a / 5000, 1.0) + 0.3 * issues / 10.0), 6) AS health FROM i""")
def _(spark, sf):
    return rounded(G.service_health(G.service_nodes(spans(spark, sf)), edges(spark, sf)), "health", digits=6)


_WALK = f"WITH RECURSIVE {_EDGES}, starts AS (SELECT DISTINCT source AS s FROM edges WHERE source NOT IN (SELECT target FROM edges)), walk AS (SELECT s AS node, [s] AS path FROM starts UNION ALL SELECT e.target, list_append(w.path, e.target) FROM walk w JOIN edges e ON e.source = w.node AND NOT list_contains(w.path, e.target) WHERE len(w.path) < {{n}}), whole AS (SELECT path FROM walk WHERE len(path) > 1 AND (len(path) = {{n}} OR node NOT IN (SELECT source FROM edges)))"


@query("g28_service_paths", _WALK.format(n=5) + " SELECT array_to_string(path, '>') AS path FROM whole")
def _(spark, sf):
    return G.service_paths(edges(spark, sf)).select(F.array_join("path", ">").alias("path"))


@query("g28_path_usage", _WALK.format(n=5) + """, t AS (SELECT trace_id, '<' || string_agg(service, '><' ORDER BY start_ts, span_id) || '>' AS walk, sum(duration_ms) AS total, bool_or(is_error) AS bad FROM spans GROUP BY trace_id),
hit AS (SELECT path, total, bad FROM t JOIN whole ON walk LIKE '%<' || array_to_string(path, '>%<') || '>%')
SELECT array_to_string(path, '>') AS path, count(*) AS traces, round(avg(total), 4) AS avg, round(count(*) FILTER (WHERE bad) / CAST(count(*) AS DOUBLE), 4) AS error_share, round(count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE), 4) AS criticality FROM hit GROUP BY path""")
def _(spark, sf):
    df = spans(spark, sf)
    return rounded(G.path_usage(G.service_paths(G.dependency_edges(df)), df).withColumn("path", F.array_join("path", ">")), "avg", "error_share", "criticality")


_TOPOLOGY = _WALK.format(n=6) + ", h AS (SELECT array_to_string(path, '>') AS id, unnest(list_transform(range(1, len(path)), lambda i: struct_pack(a := path[i], b := path[i + 1]))) AS h FROM whole WHERE len(path) >= 3) SELECT id, round(sum(lat_avg), 4) AS latency, count(*) FILTER (WHERE lat_avg > 500 OR error_rate > 10) AS bottlenecks FROM h JOIN edges e ON e.source = h.h.a AND e.target = h.h.b GROUP BY id ORDER BY sum(lat_avg) DESC, id LIMIT 10"


@query("g29_topology_paths", _TOPOLOGY)
def _(spark, sf):
    return rounded(G.topology_paths(edges(spark, sf)).select("id", "latency", "bottlenecks"), "latency")


@query("g30_levels", f"WITH RECURSIVE {_EDGES}, w AS (SELECT DISTINCT source AS service, 0 AS level FROM edges WHERE source NOT IN (SELECT target FROM edges) UNION SELECT e.target, w.level + 1 FROM w JOIN edges e ON e.source = w.service WHERE w.level < 9) SELECT service, min(level) AS level FROM w GROUP BY service")
def _(spark, sf):
    return G.levels(edges(spark, sf))


@query("g31_transitive", f"WITH {_EDGES}, a AS (SELECT target AS service, source AS via, 1 AS depth FROM edges WHERE source = 'svc-1'), b AS (SELECT e.target, e.source, 2 FROM a JOIN edges e ON e.source = a.service WHERE e.target <> 'svc-1'), u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT service, min(struct_pack(d := depth, v := via)).d AS depth, min(struct_pack(d := depth, v := via)).v AS via FROM u GROUP BY service")
def _(spark, sf):
    return G.transitive(edges(spark, sf), "svc-1", 2)


@query("g32_edge_tree", f"WITH {_BOTH} SELECT service, count(*) FILTER (WHERE side = 'in') = 0 AS is_root FROM both_ends GROUP BY service")
def _(spark, sf):
    return G.service_rollup(edges(spark, sf)).select("service", "is_root")


@query("g34_peer_calls", f"WITH {SPANS} SELECT service, operation AS peer, count(*) AS calls FROM spans WHERE service <> 'gateway' GROUP BY ALL")
def _(spark, sf):
    df = spans(spark, sf).filter("service <> 'gateway'").withColumn("attributes", F.create_map(F.lit("peer.service"), "operation"))
    return df.groupBy("service", F.col("attributes").getItem("peer.service").alias("peer")).agg(F.count("*").alias("calls"))


@query("g43_g44_g46_centrality", f"WITH {_BOTH}, p AS (SELECT service, count(*) AS k, coalesce(sum(call_count) FILTER (WHERE side = 'in'), 0) AS w FROM both_ends GROUP BY service), n AS (SELECT count(*) AS n FROM p), m AS (SELECT count(*) AS m, sum(call_count) AS c FROM edges) SELECT service, round(k / (n - 1.0), 6) AS degree, round(k / CAST(m AS DOUBLE), 6) AS betweenness, round(least(w / c, 1.0), 6) AS eigenvector FROM p, n, m")
def _(spark, sf):
    return rounded(G.centrality(edges(spark, sf)), "degree", "betweenness", "eigenvector", digits=6)


_HOPS = "h AS (SELECT s, t, 1 AS hops FROM {0} UNION SELECT h.s, u.t, h.hops + 1 FROM h JOIN {0} u ON u.s = h.t WHERE h.hops < 5), d AS (SELECT s, t, min(hops) AS hops FROM h WHERE s <> t GROUP BY ALL)"


@query("g45_closeness", f"WITH RECURSIVE {_EDGES}, dir AS (SELECT source AS s, target AS t FROM edges), {_HOPS.format('dir')} SELECT s AS service, round(count(*) / CAST(sum(hops) AS DOUBLE), 6) AS closeness FROM d GROUP BY s")
def _(spark, sf):
    return rounded(G.closeness(links(spark, sf)), "closeness", digits=6)


_RANK = _EDGES + """, lk AS (SELECT DISTINCT source, target FROM edges), nd AS (SELECT source AS node FROM lk UNION SELECT target FROM lk), c AS (SELECT count(*) AS n FROM nd), ou AS (SELECT source, count(*) AS k FROM lk GROUP BY source), fl AS (SELECT lk.source, lk.target, 1.0 / k AS w FROM lk JOIN ou USING (source)),
pr AS (SELECT 0 AS r, node, CAST(1.0 / n AS DOUBLE) AS rank FROM nd, c UNION ALL SELECT p.r + 1, nd.node, 0.15 / any_value(c.n) + 0.85 * coalesce(sum(p.rank * fl.w) FILTER (WHERE fl.target = nd.node), 0) FROM pr p JOIN c ON p.r < 20 CROSS JOIN nd LEFT JOIN fl ON fl.source = p.node AND fl.target = nd.node GROUP BY p.r, nd.node)"""


@query("g47_pagerank", "WITH RECURSIVE " + _RANK + " SELECT node AS service, round(rank, 8) AS rank FROM pr WHERE r = 20")
def _(spark, sf):
    return rounded(G.pagerank(edges(spark, sf)), "rank", digits=8)


@query("g48_cp3_key_services", "WITH RECURSIVE " + _RANK + """, bt AS (SELECT source AS service FROM edges UNION ALL SELECT target FROM edges), dg AS (SELECT service, count(*) / CAST((SELECT n FROM c) - 1 AS DOUBLE) AS degree, count(*) / CAST((SELECT count(*) FROM edges) AS DOUBLE) AS betweenness FROM bt GROUP BY service),
k AS (SELECT service, concat_ws(',', CASE WHEN degree > 0.5 THEN 'hub' END, CASE WHEN betweenness > 0.3 THEN 'bridge' END, CASE WHEN rank > 0.2 THEN 'core' END) AS roles FROM dg JOIN pr ON pr.node = dg.service AND pr.r = 20) SELECT service, roles FROM k WHERE roles <> ''""")
def _(spark, sf):
    e = edges(spark, sf)
    return G.key_services(G.centrality(e).join(G.pagerank(e), "service")).select("service", "roles")


@query("g49_components", f"WITH RECURSIVE {_UND}, r AS (SELECT s, t FROM und UNION SELECT r.s, u.t FROM r JOIN und u ON u.s = r.t) SELECT s AS service, least(s, min(t)) AS label FROM r GROUP BY s")
def _(spark, sf):
    return G.components(links(spark, sf))


@query("g50_g55_cp4_communities")
def _(spark, sf):
    e = links(spark, sf)
    labels = G.communities(e)
    return rounded(G.cohesion(e, labels).crossJoin(G.modularity(e, labels)), "cohesion", "coupling", "modularity", digits=6)


@query("g51_graph_metrics", f"WITH RECURSIVE {_UND}, {_HOPS.format('und')}, n AS (SELECT count(DISTINCT s) AS n FROM und), m AS (SELECT count(*) AS m FROM edges) SELECT n AS nodes, m AS edges, round(2.0 * m / n, 6) AS mean_degree, round(m / CAST(n * (n - 1) AS DOUBLE), 6) AS density, CAST((SELECT max(hops) FROM d) AS INT) AS diameter FROM n, m")
def _(spark, sf):
    return rounded(G.graph_metrics(links(spark, sf)), "mean_degree", "density", digits=6)


@query("g52_clustering", f"WITH {_UND} SELECT a.s AS service, round(count(l.s) / CAST(count(*) AS DOUBLE), 6) AS coefficient FROM und a JOIN und b ON a.s = b.s AND a.t < b.t LEFT JOIN und l ON l.s = a.t AND l.t = b.t GROUP BY a.s")
def _(spark, sf):
    return rounded(G.clustering_coefficient(links(spark, sf)), "coefficient", digits=6)


@query("g54_hubs", f"WITH {_BOTH}, p AS (SELECT service, count(DISTINCT other) FILTER (WHERE side = 'out') AS targets, count(DISTINCT other) FILTER (WHERE side = 'in') AS dependents FROM both_ends GROUP BY service) SELECT *, targets > 3 AS is_hub, dependents > 3 AS is_single_point FROM p WHERE targets > 3 OR dependents > 3")
def _(spark, sf):
    return G.hubs_and_single_points(edges(spark, sf))


@query("g8_j12_similar_traces", f"""WITH {SPANS}, p AS (SELECT DISTINCT trace_id, concat(service, '>', operation) AS signature FROM spans WHERE line > 0), n AS (SELECT trace_id, count(*) AS n FROM p GROUP BY trace_id), x AS (SELECT p.trace_id, count(*) AS b FROM p WHERE trace_id <> '7' AND signature IN (SELECT signature FROM p WHERE trace_id = '7') GROUP BY p.trace_id)
SELECT trace_id, round(b / CAST(n + (SELECT n FROM n WHERE trace_id = '7') - b AS DOUBLE), 6) AS similarity FROM x JOIN n USING (trace_id) WHERE b / CAST(n + (SELECT n FROM n WHERE trace_id = '7') - b AS DOUBLE) >= 0.2""")
def _(spark, sf):
    p = spans(spark, sf).filter("line > 0").select("trace_id", F.concat_ws(">", "service", "operation").alias("signature"))
    return rounded(G.similar_traces(p, "7", 0.2), "similarity", digits=6)


@query("m2_topology_score", f"WITH {_EDGES}, m AS (SELECT avg(error_rate) AS e, avg(lat_avg) AS l, count(*) FILTER (WHERE lat_avg > 500 OR error_rate > 10) AS b FROM edges) SELECT round(greatest(0.0, 100 - (least(2 * e, 40) + CASE WHEN l > 1000 THEN 30 WHEN l > 500 THEN 20 WHEN l > 200 THEN 10 ELSE 0 END + least(5 * b, 30))), 4) AS score FROM m")
def _(spark, sf):
    return rounded(G.topology_score(edges(spark, sf)), "score")
