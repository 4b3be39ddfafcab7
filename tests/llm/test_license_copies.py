"""Copies with other words between, and every license of a document."""

from tracelake.llm import license_scan


def test_words_between(documents):
    mit = license_scan.TEMPLATES["MIT"].split()
    spread = " ".join(w + (" indeed verily" if i % 3 == 0 else "") for i, w in enumerate(mit))
    rows = [(0, "Released by Foo under the terms of the MIT License"), (1, f"Some words. {spread} More words."), (2, "released soon, the word under debate is not a license")]
    out = {r.doc_id: r for r in license_scan.scan(documents(rows)).collect()}
    assert (out[0].license_id, out[0].coverage, out[0].first_word, out[0].end_word) == ("MIT-notice", 1.0, 0, 10)
    assert (out[1].license_id, out[1].coverage) == ("MIT", 1.0) and out[2].license_id is None


def test_every_license_is_listed(documents):
    mit, cc, notice = (license_scan.TEMPLATES[k] for k in ("MIT", "CC-BY-NC-notice", "MIT-notice"))
    rows = [(0, f"a b c {notice} d e {mit} f g {cc.replace('#', '3')} h {notice} i"), (1, f"{mit} {mit}"), (2, None)]
    out = {r.doc_id: r for r in license_scan.scan(documents(rows)).collect()}
    found = sorted((x.first_word, x.license_id, x.coverage) for x in out[0].licenses)
    assert [x[1:] for x in found] == [("MIT-notice", 1.0), ("MIT", 1.0), ("CC-BY-NC-notice", 1.0), ("MIT-notice", 1.0)]
    assert out[0].license_id == "MIT" and out[0].n_licenses == 3
    assert [x.license_id for x in out[1].licenses] == ["MIT", "MIT"] and {x.coverage for x in out[1].licenses} == {1.0} and out[2].licenses == []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def found(spark, text, **how):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {x["license_id"]: x for x in license_scan.scan(df, **how).first()["licenses"]}


def test_long_templates_are_found_however_far_apart(spark):
    words = license_scan.TEMPLATES["MIT"].split()
    spread = [w for i, x in enumerate(words) for w in (x, *(f"w{i}x{k}" for k in range(200 if i in (10, 40) else 3)))]
    assert found(spark, " ".join(spread))["MIT"]["coverage"] == 1.0


def test_a_short_notice_within_forty_words(spark):
    near = "Released by Foo Bar and its many friends all over the world in two thousand twenty under the terms of the MIT License."
    assert found(spark, near)["MIT-notice"]["coverage"] == 1.0
    far = "Released " + "word " * 100 + "under the " + "word " * 100 + "MIT License."
    assert "MIT-notice" not in found(spark, far)


def test_coverage_is_never_above_the_longest_common_subsequence(spark):
    import random

    r = random.Random(4)
    words = [f"t{i}" for i in range(60)] + ["a", "b"] * 4
    for _ in range(6):
        template = [r.choice(words) for _ in range(26)]
        text = [w for x in template for w in ([x] if r.random() < 0.9 else []) + [r.choice(words + ["z"]) for _ in range(r.randrange(3))]]
        got = found(spark, " ".join(text), templates={"t": " ".join(template)}, least=0.5)
        most = lcs(text, template) / len(template)
        assert "t" in got and 0.8 * most <= got["t"]["coverage"] <= most + 1e-9
