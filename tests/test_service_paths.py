"""Service paths of five and six nodes, against brute force."""

import datetime

from tracelake.plans import catalog, q_graph

EDGES = "source string, target string, call_count long, lat_avg double, error_rate double"
CHAIN = [(a, b, 10, 100.0 * i, 5.0 * i) for i, (a, b) in enumerate(zip("abcdefg", "bcdefgh", strict=True), 1)] + [("b", "z", 5, 1.0, 0.0), ("c", "a2", 1, 7.0, 0.0)]


def walks(edges, most):
    outs, out = {}, []
    for s, t, *_ in edges:
        outs.setdefault(s, []).append(t)

    def go(path):
        if len(path) == most or path[-1] not in outs:
            out.append(">".join(path))
            return
        for t in outs[path[-1]]:
            if t not in path:
                go([*path, t])

    for s in set(outs) - {t for _, t, *_ in edges}:
        go([s])
    return sorted(p for p in out if ">" in p)


def test_paths_of_five_and_six(spark, monkeypatch):
    monkeypatch.setattr(q_graph, "edges", lambda spark, sf: spark.createDataFrame(CHAIN, EDGES))
    assert sorted(r.path for r in catalog.queries()["g28_service_paths"](spark, "").collect()) == walks(CHAIN, 5)
    lat = {(s, t): (v, e) for s, t, _, v, e in CHAIN}
    want = {}
    for p in walks(CHAIN, 6):
        hops = [lat[h] for h in zip(p.split(">")[:-1], p.split(">")[1:], strict=True)]
        if len(hops) >= 2:
            want[p] = (sum(v for v, _ in hops), sum(v > 500 or e > 10 for v, e in hops))
    assert {r.id: (r.latency, r.bottlenecks) for r in catalog.queries()["g29_topology_paths"](spark, "").collect()} == want


def test_usage_of_whole_paths(spark, monkeypatch):
    rows = [("t1", f"p{i}", f"p{i - 1}" if i else None, s) for i, s in enumerate("abcdef")] + [("t2", "q0", None, "a"), ("t2", "q1", "q0", "b")]
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(a, b, c, s, t + datetime.timedelta(seconds=i), 10.0, False) for i, (a, b, c, s) in enumerate(rows)], "trace_id string, span_id string, parent_span_id string, service string, start_ts timestamp_ntz, duration_ms double, is_error boolean")
    monkeypatch.setattr(q_graph, "spans", lambda spark, sf: df)
    got = [(r.path, r.traces) for r in catalog.queries()["g28_path_usage"](spark, "").collect()]
    assert got == [("a>b>c>d>e", 1)]


def test_usage_against_every_trace(spark):
    """Walks with repeats, paths that are beginnings of others, traces without duration."""
    import itertools
    import random

    from tracelake.operators import graph

    rng = random.Random(3)
    t = datetime.datetime(2024, 1, 1)
    walks_of = {f"t{i}": [rng.choice("abcd") for _ in range(rng.randrange(1, 8))] for i in range(80)}
    rows = [(k, f"s{i}", s, t + datetime.timedelta(seconds=i), None if k == "t3" else float(i), i == 2) for k, w in walks_of.items() for i, s in enumerate(w)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, service string, start_ts timestamp_ntz, duration_ms double, is_error boolean")
    paths = [list(p) for n in (2, 3, 4) for p in itertools.permutations("abcd", n)] + [["a"], ["x", "a"]]
    want = {}
    for p in paths:
        hit = [w for w in walks_of.items() if all(s in it for it in [iter(w[1])] for s in p)]
        if hit:
            known = [float(sum(range(len(w)))) for k, w in hit if k != "t3"]
            want[tuple(p)] = (len(hit), round(sum(known) / len(known), 6) if known else None, round(sum(len(w) > 2 for _, w in hit) / len(hit), 6), round(len(hit) / 80, 6))
    out = graph.path_usage(spark.createDataFrame([(p,) for p in paths], "path array<string>"), df)
    got = {tuple(r.path): (r.traces, r.avg if r.avg is None else round(r.avg, 6), round(r.error_share, 6), round(r.criticality, 6)) for r in out.collect()}
    assert got == want and len(got) > 50
    assert "aggregate(walk" not in out._jdf.queryExecution().optimizedPlan().toString()
