"""What is used several times is computed once: later steps read its table."""

import datetime

from tracelake.operators import composites, trees

_SPANS = "trace_id string, span_id string, parent_span_id string, service string, operation string, start_ts timestamp_ntz, duration_ms double, is_error boolean"


def spans(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(f"t{i}", f"{i}-{j}", f"{i}-{j - 1}" if j else None, "abc"[j], f"o{j}", t + datetime.timedelta(seconds=j), 10.0 * (i + 1), i == 0) for i in range(12) for j in range(3)]
    return spark.createDataFrame([*rows, ("t1", "1-x", "1-0", "b", "o1", t, None, False)], _SPANS)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_traced_graph_from_trace_totals(spark):
    out = composites.traced_graph(spans(spark), 10)
    assert "parent_span_id" not in plan(out) and "Expand" not in plan(out)
    got = {(r.source, r.target): r for r in out.collect()}
    e = got["a", "b"]
    assert (e["count"], e.errors, e.traces, e.avg, len(e.trace_ids)) == (13, 1, 12, 65.0, 10)
    assert got["b", None].traces == 12 and got["b", None]["count"] == 13


def test_edge_outliers_read_their_edges(spark):
    assert "trace_id string" not in plan(composites.edge_outliers(spans(spark), t=0.1)) and "parent_span_id" not in plan(composites.edge_outliers(spans(spark), t=0.1))


def test_path_summary_finds_paths_once(spark):
    out = trees.path_summary(trees.path_stats(trees.critical_paths(spans(spark).filter("span_id <> '1-x'"))))
    assert "MapInArrow" not in plan(out) and "parent_span_id" not in plan(out)
    assert (out.first()["mean_length"], out.first()["pattern"]) == (3.0, "a:o0 -> b:o1 -> c:o2")


def test_predictions_derive_their_spans_once(spark):
    from tracelake.plans import q_prediction

    out = plan(q_prediction.found(spark, "/root/testdata/sf0.001"))
    assert "l_orderkey" not in out and "o_orderkey" not in out


def test_health_summary_groups_traces_once(spark):
    from tracelake.operators import incident

    rows = spans(spark).unionByName(spark.createDataFrame([(None, "x", None, "a", "o0", None, 5.0, True)], _SPANS))
    logs = spark.createDataFrame([("error", "failed"), ("info", "fine")], "level string, message string")
    metrics = spark.createDataFrame([("cpu", 1.0)], "metric string, value double")
    edges = spark.createDataFrame([("a", "b", 12, 0.0)], "source string, target string, call_count long, error_rate double")
    out = incident.health_summary(rows, logs, metrics, edges, {"cpu": "cpu", "memory": "memory"})
    assert "Expand" not in plan(out)
    assert (out.first().traces, round(out.first().error_percent, 6)) == (12, round(100 / 12, 6))


def test_links_derive_their_spans_once(spark):
    from tracelake.operators import graph

    odd = [("t1", "1-y", "1-1", "unknown"), ("t1", "1-z", "no-such", "c"), (None, "1-w", "1-0", "c"), ("t1", "1-0", None, "d"), ("t2", "2-y", "2-1", "b")]
    rows = spans(spark).unionByName(spark.createDataFrame([(*r, "o1", None, 1.0, False) for r in odd], _SPANS))
    out = graph.links(rows)
    assert "trace_id" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [("a", "b"), ("b", "c"), ("d", "b")]  # two roots of t1 share an id


def test_communities_read_neither_latencies_nor_errors(spark, monkeypatch):
    from tracelake.operators import graph
    from tracelake.plans import catalog, fixtures

    sf, read = "/root/testdata/sf0.001", []
    e = graph.dependency_edges(fixtures.spans(spark, sf))
    monkeypatch.setattr(graph, "cut_lineage", lambda df, cut=graph.cut_lineage: read.append(plan(df)) or cut(df))
    got = catalog.queries()["g50_g55_cp4_communities"](spark, sf).collect()
    derived = [p for p in read if "l_orderkey" in p]
    assert len(derived) == 1 and not any(c in derived[0] for c in ("l_quantity) AS", "max(l_returnflag", "max(l_linestatus"))
    want = graph.cohesion(e, graph.communities(e)).collect()
    assert {(r.label, r.size, r.internal, r.external) for r in got} == {(r.label, r.size, r.internal, r.external) for r in want}
