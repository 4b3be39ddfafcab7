"""Exact dedup, suffix-array dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import exact_dedup, jaccard_join, suffix_dedup
from tracelake.llm.components import components, roots

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "été", "re", "thing"]) + str(r.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    base = prose(1, 300)
    passage = prose(2, 40)
    rows = [(0, base), (1, base.upper()), (2, None), (3, ""), (4, "few words"), (5, "few words"), (6, base), (6, base), (7, prose(3, 80) + "\n" + passage), (8, passage + " " + prose(4, 90)), (9, prose(5, 3000) + passage), (10, "a"), (None, base), (11, "ÀB À")]
    for k in range(12):
        w = base.split()
        random.Random(k).shuffle(w[:0])
        for p in random.Random(k).sample(range(300), 4 if k % 2 else 9):
            w[p] = f"edit{k}"
        rows.append((20 + k, " ".join(w)))
    return rows


def test_exact_groups(documents, corpus):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(documents(corpus), 4).collect()}
    groups = {}
    for i, t in corpus:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    expected = set()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        expected |= {(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    assert got == expected


def test_many_repeated_digests_are_not_broadcast(documents, corpus):
    few, many = (exact_dedup.text_groups(documents(corpus), 4, most) for most in (100, 0))
    assert few.count() == 3 and sorted(few.collect()) == sorted(many.collect())
    assert "Broadcast" in few._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()


def test_many_copies_are_not_broadcast(documents, corpus, monkeypatch):
    few = exact_dedup.drop_copies(documents(corpus), 4).select("doc_id", "text")
    monkeypatch.setattr("tracelake.llm.common.MOST_SENT", 0)
    many = exact_dedup.drop_copies(documents(corpus), 4, 0).select("doc_id", "text")
    assert few.count() == 21 and Counter(map(tuple, few.collect())) == Counter(map(tuple, many.collect()))
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()


def test_dropping_copies_keeps_the_columns(documents, corpus):
    docs = documents(corpus)
    kept = exact_dedup.drop_copies(docs, 4)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {3, 5, 6, 7, 8, 9, 10, 11} and not {0, 2, 4} & {r.doc_id for r in kept.collect()}


def brute_repeats(rows, n=50):
    first, out = {}, {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first.setdefault(b[k : k + n], i) < i:
                gone[k : k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.setdefault(i, set()).add((len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_repeats(documents, corpus, parts):
    rows = [*corpus, (4, prose(3, 80))]  # an id with two texts
    expected = brute_repeats(rows)
    for r in suffix_dedup.remove_repeats(documents(rows, parts), shards=3).collect():
        found = (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert found in expected[r.doc_id]


@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(x % 4 for x in b)))
@settings(max_examples=200, deadline=None)
def test_suffix_order(data):
    assert suffix_dedup.suffix_order(np.frombuffer(data, dtype=np.uint8), 10**6).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def brute_components(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return sets, comp


def test_near_copies(documents, corpus):
    sets, comp = brute_components(corpus)
    assert len(set(comp.values())) < len(comp)
    for r in jaccard_join.join(documents(corpus)).collect():
        expected = (len(sets[0]), 0) if r.doc_id is None else (len(sets[r.doc_id]), comp[r.doc_id])
        assert (r.n_shingles, r.component_id) == expected
    kept = [r.doc_id for r in jaccard_join.keep_one(documents(corpus)).collect()]
    assert sorted(kept) == sorted(set(comp.values()))


def test_one_row_stays_of_ids_that_repeat(documents):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(5, a), (9, a), (5, b), (None, a), (None, prose(3, 60)), (7, b), (7, b), (4, None), (4, None)]
    assert sorted((r.doc_id or 0, r.text) for r in jaccard_join.keep_one(documents(rows)).filter("text is not null").collect()) == sorted([(5, a), (5, b), (0, prose(3, 60))])
    kept = sorted((r.doc_id or 0, r.text or "") for r in exact_dedup.drop_copies(documents(rows)).collect())
    assert kept == sorted([(9, a), (0, prose(3, 60)), (7, b), (4, "")])


def test_links_come_from_the_trees(documents):
    """Hub searches link most of a group, the others the rest; a block dealt over several trees gives the same."""
    r = random.Random(3)
    rows = []
    for g in range(3):
        base = prose(100 + g, 200).split()
        for k in range(20):
            w = list(base)
            for p in r.sample(range(200), r.choice([1, 3, 5])):
                w[p] = f"x{g}y{k}z{p}"
            rows.append((g * 100 + k, " ".join(w)))
    docs = documents(rows)
    _, comp = brute_components(rows)
    profiled = jaccard_join.saved(jaccard_join.profiles(docs, jaccard_join.shingle_ranks(docs), 5, 80))
    nodes, blocks = jaccard_join.blocks_of(profiled)
    points = profiled.selectExpr("row as id", "n", "point")
    hubs = jaccard_join.verified(jaccard_join.hub_pairs(jaccard_join.near_hubs(blocks, points, 80)), docs, nodes, 5, 80)
    joined = len(comp) - len(set(comp.values()))  # links that make the components
    assert joined >= 20 and 0.8 * joined <= hubs.count() <= joined
    for chunk in (jaccard_join.CHUNK, 7):
        was, jaccard_join.CHUNK = jaccard_join.CHUNK, chunk
        try:
            out = {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()}
        finally:
            jaccard_join.CHUNK = was
        assert out == comp


def test_shards_sort_only_pieces_with_repeats(monkeypatch):
    """Of many pieces, only those that hold a string of 50 bytes twice reach the suffix array."""
    r = np.random.default_rng(5)
    size, n = 100, 4000
    text = r.integers(97, 123, (n, size), dtype=np.uint8)
    text[1::8, 20:80] = text[::8, 30:90]
    text[1::8, [19, 80]] = 65  # the copies end here
    sorted_bytes = []
    inner = suffix_dedup.repeated

    def noted(text, *rest):
        sorted_bytes.append(len(text))
        return inner(text, *rest)

    monkeypatch.setattr(suffix_dedup, "repeated", noted)
    zeros, ids = np.zeros(n, dtype=np.int64), np.arange(n)
    found = suffix_dedup.removed_in_shard(ids, zeros, zeros, np.full(n, size - 49), text.ravel())
    assert sorted(zip(found[0].tolist(), found[2].tolist(), found[3].tolist(), strict=True)) == [(k, 20, 80) for k in range(1, n, 8)]
    assert sorted_bytes == [n // 4 * size]


def test_blocks_share_the_pairs(documents):
    """Two sets with many shingles in common meet in many blocks; one of those proposes them, and none is lost."""
    r = random.Random(7)
    base = prose(200, 200).split()
    rows = []
    for k in range(60):
        w = list(base)
        for p in r.sample(range(200), r.choice([1, 4, 7])):
            w[p] = f"y{k}z{p}"
        rows.append((k, " ".join(w)))
    docs = documents(rows)
    profiled = jaccard_join.saved(jaccard_join.profiles(docs, jaccard_join.shingle_ranks(docs), 5, 80))
    _, blocks = jaccard_join.blocks_of(profiled)
    points = profiled.selectExpr("row as id", "n", "point")
    each = profiled.selectExpr("row as id", "row as label")
    found = [tuple(sorted(p)) for p in jaccard_join.outside(blocks, each, points, 80).collect()]
    members = {}
    for b in blocks.filter("size > 2").collect():
        members.setdefault(b.token, set()).add(b.id)
    point = {p.id: p for p in points.collect()}
    meet = {tuple(sorted((a, b))) for m in members.values() for a in m for b in m if a < b}
    expected = set()
    for a, b in meet:
        (m, x), (n, y) = sorted((int(jaccard_join.level(p.n)), bytes(p.point)) for p in (point[a], point[b]))
        low, high = jaccard_join.folded([x], m, m), jaccard_join.folded([y], n, m)
        na, nb = point[a].n, point[b].n
        if 100 * min(na, nb) >= 80 * max(na, nb) and np.minimum(low, high).sum() >= jaccard_join.required(na, nb):
            expected.add((a, b))
    assert expected and set(found) == expected
    assert len(found) <= 2 * len(expected) < sum(len(m) * (len(m) - 1) // 2 for m in members.values())


def test_tree_finds_all_members_above_the_bound():
    r = np.random.default_rng(0)
    points = r.integers(0, 6, (500, 16))
    tree = jaccard_join.CountTree(points)
    for q in points[:20]:
        least = jaccard_join.required(np.full(500, q.sum()), points.sum(axis=1))
        assert sorted(tree.search(q, least)) == np.flatnonzero(np.minimum(points, q).sum(axis=1) >= least).tolist()


def test_long_chains_are_one_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.label for r in components(e).collect()} == {0}


def test_roots_of_a_forest(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102)], "a long, b long")
    assert {(r.node, r.label) for r in roots(e).collect()} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_empty_tables(documents):
    none = documents([])
    assert exact_dedup.exact_groups(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert jaccard_join.join(none).count() == 0
