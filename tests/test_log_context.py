"""Context of every error log, against brute force."""

import datetime

from tracelake.plans import catalog, q_basic


def test_context_of_every_error(spark, monkeypatch):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, f"svc-{i % 3}", "error" if i % 4 == 0 else "info", t + datetime.timedelta(seconds=i * i * 13 % 40000)) for i in range(1, 160)]
    monkeypatch.setattr(q_basic, "logs", lambda spark, sf: spark.createDataFrame(rows, "event_id long, service string, level string, ts timestamp_ntz"))
    want = set()
    for i, service, level, at in rows:
        if level == "error":
            near = [((abs((x[3] - at).total_seconds()), x[0]), "before" if x[3] < at else "after") for x in rows if x[1] == service and x[0] != i and abs((x[3] - at).total_seconds()) <= 3600]
            want |= {(i, k[1], side) for s in ("before", "after") for k, side in sorted(n for n in near if n[1] == s)[:3]}
    got = [tuple(r) for r in catalog.queries()["p15_j10_log_context"](spark, "").collect()]
    assert len(got) == len(want) and set(got) == want and any(hit % 50 for hit, *_ in got)


def test_context_in_crowds(spark):
    """Many logs at one moment: what is read for a hit doesn't grow with them."""
    from tracelake.operators import context

    t = datetime.datetime(2024, 1, 1)
    rows = [(i, "a", t + datetime.timedelta(seconds=600 * (i % 14))) for i in range(400)] + [(1000 + i, "b", t) for i in range(3)] + [(2000, "a", t + datetime.timedelta(days=2))]
    logs = spark.createDataFrame(rows, "id long, service string, ts timestamp_ntz").cache()
    hits = logs.filter("id % 3 = 0 or id = 2000")
    want = set()
    for i, service, at in rows:
        if i % 3 == 0 or i == 2000:
            for side in ("before", "after"):
                near = sorted((abs((x[2] - at).total_seconds()), x[0]) for x in rows if x[1] == service and x[0] != i and abs((x[2] - at).total_seconds()) <= 3600 and (x[2] < at) == (side == "before"))
                want |= {(i, k, side) for _, k in near[:3]}
    out = context.log_context(hits, logs, "id", 3, 3600)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_h" not in plan and "row_number() windowspecdefinition(hit" not in plan  # hits and logs aren't paired before they are ranked
