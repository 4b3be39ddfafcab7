"""Quality, language, licenses, decontamination, packing, pages and URLs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, html_text, language, license_scan, packing, quality, url_rules

WORDS = {"en": "the and of thing water house seven mother".split(), "fr": "le la été maison mère eau sept chose".split()}


def prose(seed, n, lang="en"):
    r = random.Random(seed)
    return ". ".join(" ".join(r.choice(WORDS[lang]) + r.choice(["", "s", "er"]) for _ in range(9)) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark, documents):
    rows = [(i, prose(i, 6) if i % 3 else " ".join(w.upper() + "!!%%%" for w in prose(i, 6).split())) for i in range(120)]
    return documents([*rows, (500, None), (501, ""), (502, "x")]), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)] + [(900, 1), (3, None)], "doc_id long, quality int")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(out) == 123
    for i in range(120):
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert out[i].predicted == int(i % 3 > 0) == int(out[i].score >= 0.5)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_quality_filter_keeps_columns(labelled):
    docs, labels = labelled
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & set(range(120)) == {i for i in range(120) if i % 3}


def test_quality_without_labels(labelled):
    docs, labels = labelled
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_language(spark):
    rows = [(i, prose(i, 5, "en" if i % 2 else "fr"), "en" if i % 2 else "fr") for i in range(60)] + [(100, None, "en"), (101, "12 34 !", "fr"), (102, "", None)]
    out = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].lang_pred == ("en" if i % 2 else "fr") for i in range(60))
    assert {out[i].lang_pred for i in (100, 101, 102)} == {"und"} and all(0 <= r.score <= 1 for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.values())


def test_licenses(documents):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(0, prose(0, 30) + "\n" + mit + "\n" + prose(1, 30)), (1, mit.replace("copy", "clone").lower()), (2, "Licensed under CC BY-NC 4.0.\n" + prose(2, 3)), (3, prose(3, 50)), (4, None), (5, ""), (6, ("Released under the MIT License.\n" + prose(4, 2) + "\n") * 2)]
    out = {r.doc_id: r for r in license_scan.scan(documents(rows)).collect()}
    assert {i: out[i].license_id for i in out} == {0: "MIT", 1: "MIT", 2: "CC-BY-NC-notice", 3: None, 4: None, 5: None, 6: "MIT-notice"}


def test_patience_alignment():
    assert license_scan.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    assert license_scan.align([9, 1, 2, 2, 3, 8], [1, 2, 2, 3]) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_decontamination(spark, documents):
    item = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item), (2, "three short words"), (3, None), (4, "")], "item_id long, text string")
    half, rest = item.split()[:20], item.split()[20:]
    rows = [(0, prose(0, 5) + " " + item.upper().replace(" ", ", ")), (1, " ".join(rest) + prose(1, 3) + " " + " ".join(half)), (2, prose(2, 5) + " w1 w2 w3 w4 w5"), (3, None), (4, ""), (5, "Three, SHORT words!"), (6, "short words three")]
    docs = documents(rows)
    out = {r.doc_id: r for r in decontaminate.scan(docs, bench).collect()}
    assert {i for i, r in out.items() if r.contaminated} == {0, 1, 5} and out[0].item_id == 1 and out[1].n_tiles == 2
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {2, 3, 4, 6}
    assert not any(r.contaminated for r in decontaminate.scan(docs, bench.limit(0)).collect())


def test_benchmark_in_blocks(spark, documents):
    bench = spark.createDataFrame([(k, " ".join(f"x{k}y{i}" for i in range(12))) for k in range(30)], "item_id long, text string")
    docs = documents([(k, " ".join(f"x{k}y{i}" for i in range(12))) for k in range(30)])
    found = [decontaminate.scan_block(docs, items, 0.6).filter("item_id is not null") for items in decontaminate.blocks_of(bench, 500)]
    assert len(found) > 1 and sorted((r.doc_id, r.item_id) for f in found for r in f.collect()) == [(k, k) for k in range(30)]


def test_tiles_do_not_overlap():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 4, 80).astype(np.uint64), r.integers(0, 4, 60).astype(np.uint64)
    used_a, used_b = set(), set()
    for i, j, n in decontaminate.tiles(a, b, 3):
        assert (a[i : i + n] == b[j : j + n]).all() and not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


def test_packing(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, prose(i, 1 + i % 40)) for i in range(60)] + [(100, None), (101, ""), (102, prose(7, 500)), (103, "a <|endoftext|> b"), (5, prose(5, 6))]
    docs = documents(rows)
    out = packing.pack(docs, ids=True).collect()
    ids = {}
    for i, x in rows:
        ids.setdefault(i, []).append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    seqs = {}
    for r in out:
        assert zlib.crc32(np.array(r.ids, dtype="<u4")) == r.ids_crc32
        assert any(zlib.crc32(v[r.start : r.start + r.length]) == r.ids_crc32 and r.start + r.length <= len(v) for v in ids[r.doc_id])
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(len(v) for x in ids.values() for v in x)
    whole = packing.sequences(docs).collect()
    assert len({r.sequence_id for r in whole}) == len(whole) == len(seqs) and sum(len(r.ids) for r in whole) == total
    assert sorted(i for r in whole for i in r.ids) == sorted(int(i) for x in ids.values() for v in x for i in v)
    assert sum(r.length for r in out) == total and len(seqs) == -(-total // 2048)
    assert [(r.start, r.length) for r in sorted(out, key=lambda r: r.piece) if r.doc_id == 102][1:] == [(s, 2048) for s in packing.cuts(len(ids[102][0]), 2048)[1:]]


def test_plans_place_every_piece_once():
    r = random.Random(3)
    for _ in range(50):
        counts = {r.randrange(1, 101): r.randrange(1, 30) for _ in range(r.randrange(1, 20))}
        left = dict(counts)
        for held, n in packing.plan(counts, 100):
            assert sum(held) <= 100
            for s in held:
                left[s] -= n
        assert not any(left.values())
    assert sum(n for _, n in packing.plan({60: 3, 40: 3, 55: 2, 45: 2}, 100)) == 5


ARTICLE = "<article><h1>T&amp;t</h1><p>One\n two <b>bold</b>.<p>Three<br>four</p></article>"


def test_pages(spark):
    rows = [(i, f"https://H.example.org/{i}", f"<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><a>menu</a></nav><div class='promo-x9'>Same on all pages</div>{ARTICLE}<section class='comments'><p>hm</p></section><footer>f</footer></body>") for i in range(3)]
    rows += [(10 + i, "http://plain.example.org/x", f"<div>Site name</div><div><p>Own text {i} of this page, which is long</p></div><div>Site end</div>") for i in range(6)]
    rows += [(20, None, None), (21, "http://a.b", ""), (22, "http://a.b", "<p>cut &am"), (23, "http://a.b", "<article><p>copied text</article>"), (24, "http://a.b", "just text &lt;b&gt;")] + [(30 + i, "http://copy.org", "<article><p>copied text</article>") for i in range(9)]
    out = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("template", F.lit("x"))).collect()}
    assert out[0].text == "T&t\n\nOne two bold.\n\nThree four"
    assert out[12].text == "Own text 2 of this page, which is long"
    assert [out[i].text for i in (20, 21, 22, 24)] == ["", "", "cut &am", "just text <b>"]
    assert all(out[30 + i].text == "copied text" for i in range(9)) and all(r.n_chars == len(r.text) for r in out.values())


def test_urls(spark):
    cases = {
        "https://a.Example.org/es/x": ("example.org/es/", "block"), "http://example.org/en/12?q": ("example.org/en/1", "block"), "http://example.org/en/2": ("org/", "allow"), "http://x.com/fr/": ("com/fr/", "allow"),
        "http://x.com/de/1#t": ("com/de/", "block"), "http://x.com/de": (None, "allow"), "http://notorg/": (None, "allow"), "http://x.org": (None, "allow"), "no scheme org/": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "http://myexample.org/es/": ("org/", "allow"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("rule", F.lit(1))
    out = {r.page_id: r for r in url_rules.judge_urls(df).collect()}
    assert [(out[i].rule, out[i].verdict) for i in range(len(cases))] == list(cases.values())
    assert (out[0].host, out[0].path) == ("a.example.org", "/es/x") and (out[9].host, out[9].path) == ("", "")


def test_empty_tables(spark, documents):
    none = documents([])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (quality.classify(none, labels), language.identify(none), license_scan.scan(none), decontaminate.scan(none, bench), packing.pack(none), html_text.extract(pages), url_rules.judge_urls(pages)):
        assert df.count() == 0
