"""Rule lists of any length give what each url's rules give one by one."""

import random

import pytest

from tracelake.llm import url_rules


def judged(url, rules):
    host, slash, path = (url or "").partition("://")[2].partition("/")
    host, path = host.lower(), slash + path
    fit = [(len(r), v == "block", r) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    best = max(fit, default=None)
    return (best[2], "block" if best[1] else "allow") if best else (None, "allow")


@pytest.mark.parametrize("most_inline", [100, 0])
def test_lists_of_any_length(spark, most_inline):
    r = random.Random(5)
    hosts = [f"{a}.{b}" for a in ("a", "b", "c.d", "x-y") for b in ("org", "com", "de")]
    rules = [(r.choice(["allow", "block"]), f"{r.choice(hosts)}/{'/'.join(r.choice('pqr') for _ in range(r.randrange(4)))}") for _ in range(60)] + [("block", "org/"), ("allow", "org/")]
    urls = [None, "", "no", *(f"http://{r.choice(['', 'www.'])}{r.choice(hosts)}/{'/'.join(r.choice('pqrs') for _ in range(r.randrange(5)))}" for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {x.page_id: (x.rule, x.verdict) for x in url_rules.judge_urls(df, rules, most_inline=most_inline).collect()}
    assert out == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_fifty_thousand_rules(spark):
    rules = [("block", f"h{i}.org/p{i % 7}/") for i in range(50_000)]
    df = spark.createDataFrame([(i, f"http://www.h{i * 100}.org/p{i * 100 % 7}/x") for i in range(400)] + [(999, "http://h1.org/")], "page_id long, url string")
    out = {x.page_id: x.rule for x in url_rules.judge_urls(df, rules).collect()}
    assert out.pop(999) is None and out == {i: f"h{i * 100}.org/p{i * 100 % 7}/" for i in range(400)}
    assert url_rules.judge_urls(df, []).filter("verdict = 'allow' and rule is null").count() == 401
