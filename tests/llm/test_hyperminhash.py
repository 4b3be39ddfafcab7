"""HyperMinHash classes against all pairs of sets, and the sketches against true similarities."""

import random
import re

import numpy as np
import pytest

from tracelake.llm import hyperminhash as H


def sets(rows):
    out = []
    for doc_id, text in rows:
        w = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append((doc_id, frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()))
    return out


def brute(rows, percent=80):
    s, top = sets(rows), list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, a) in enumerate(s):
        for j in range(i):
            b = s[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(s):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    lead = [least.get(find(i)) if a else d for i, (d, a) in enumerate(s)]
    return sorted(((d, len(a), c, d == c) for (d, a), c in zip(s, lead, strict=True)), key=str)


def got(docs, **how):
    return sorted((tuple(r) for r in H.near_duplicates(docs, **how).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def edited(r, words, share):
    return [r.choice("xyz") + str(r.randrange(99)) if r.random() < share else w for w in words]


def corpus(seed, groups, each):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 5, 8, 30, 200, 900]))]
        rows += [(len(rows) + k, " ".join(edited(r, base, r.choice([0, 0.01, 0.03, 0.06])))) for k in range(r.randrange(1, each))]
    return rows


@pytest.mark.parametrize(("seed", "groups", "each", "chunk"), [(1, 40, 6, H.CHUNK), (3, 4, 90, 4)])
def test_equals_brute_force(spark, documents, seed, groups, each, chunk):
    rows = corpus(seed, groups, each)
    rows += [(9001, None), (9002, ""), (9003, " \n "), (9004, "One two"), (9005, "one TWO"), (9006, "one two three four"), (9007, "one two three four five"), (None, rows[3][1]), (None, "alone here"), rows[4], rows[4], (9010, "long text of words " * 20_000), (9011, "long text of words " * 20_001)]
    have = got(documents(rows, 5), chunk=chunk, parts=2 if chunk == 4 else H.PARTS)
    assert have == brute(rows)
    assert sum(not w[3] for w in have) > 20


def test_no_rows_and_other_thresholds(spark, documents):
    assert got(documents([])) == []
    rows = corpus(5, 12, 6)
    assert got(documents(rows), percent=90) == brute(rows, 90)
    with pytest.raises(ValueError):
        H.near_duplicates(documents(rows), percent=70)


def test_estimates_and_collisions():
    r = np.random.default_rng(7)
    for n in (4, 30, 500, 20_000):
        errors = []
        for _ in range(40):
            u = r.integers(0, 1 << 63, size=n + n // 5 + 1, dtype=np.int64).astype(np.uint64)
            a, b = u[: n + 1], u[len(u) - n - 1 :]
            true = len(np.intersect1d(a, b)) / len(u)
            errors.append(float(H.similarity(H.registers(a), H.registers(b), len(a), len(b))) - true)
        assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.25
    # sketches of disjoint sets are equal as often as the formula says
    same = [np.mean(H.registers(x[:3000]) == H.registers(x[3000:])) for x in r.integers(0, 1 << 63, size=(3000, 6000), dtype=np.int64).astype(np.uint64)]
    assert abs(np.mean(same) / H.collisions(3000, 3000) - 1) < 0.25


def test_registers_by_hand(monkeypatch):
    monkeypatch.setattr(H, "mix", lambda h: h)
    low = np.uint64((5 << 57) | (0b00010110000 << 46))  # bucket 5, three leading zeros, then 1, then 0110000...
    out = H.registers(np.array([low, low | np.uint64(1 << 56)], dtype=np.uint64))
    assert out[5] == (3 << 11) | (0b01100000000) and (out == out[5]).all()


def test_large_blocks_part_before_they_are_compared(spark, documents):
    """Members that share one band only don't stay in one block."""
    r = np.random.default_rng(3)
    points = r.integers(0, 1 << 16, size=(400, H.BUCKETS), dtype=np.int64).astype(np.uint16)
    points[:, : H.ROWS] = 7  # one band in common
    points[1] = points[0]
    sets = spark.createDataFrame([(i, 100, bytes(p.tobytes())) for i, p in enumerate(points)], "id long, n long, point binary")
    blocks = H.blocks_of(H.banded(sets.select("id", "point")))
    assert blocks.filter("size = 400").count() == 400
    left = H.parted(blocks, sets, 16)
    assert {w.id for w in left.collect()} == {0, 1} and left.agg({"size": "max"}).first()[0] == 2
