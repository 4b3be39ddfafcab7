"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.llm import merkle


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in merkle.FIELDS)))


def tree(leaves: list[str], arity: int) -> tuple[str, list[list[str]]]:
    """(top, siblings of each leaf from below to above, as one list of (slot, others))."""
    at, steps, now = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(now) > 1:
        for i, a in enumerate(at):
            run = now[a - a % arity : a - a % arity + arity]
            steps[i].append((a % arity, run[: a % arity] + run[a % arity + 1 :]))
            at[i] = a // arity
        now = [H(*now[k : k + arity]) for k in range(0, len(now), arity)]
    return now[0], steps


def climb(h: str, steps) -> str:
    for slot, others in steps:
        h = H(*others[:slot], h, *others[slot:])
    return h


def brute(rows: list[dict], arity: int) -> dict:
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {lang: sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for lang in langs}
    subs = {lang: tree([leaf(r) for r in of[lang]], arity) for lang in langs}
    root, ups = tree([subs[lang][0] for lang in langs], arity)
    out = []
    for lang, up in zip(langs, ups, strict=True):
        for r, steps in zip(of[lang], subs[lang][1], strict=True):
            n = r["n_chars"]
            if n is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                n += 1
            got = climb(leaf(r | {"n_chars": n}), steps + up)
            out.append((r["doc_id"], leaf(r), subs[lang][0], root, H(*(x for _, others in steps + up for x in others)), got, got == root))
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({c: F.lit("x") for c in ("tree", "idx", "n", "hash", "step", "path", "root", "height", "_tree", "_at")})


def results(docs, arity=2):
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    x = merkle.as_hex
    rows = merkle.manifest(docs, {"n_chars": other}, arity).withColumn("folded", merkle.folded(F.col("other"), F.col("path")))
    rows = rows.select("doc_id", x(F.col("leaf")), x(F.col("subroot")), x(F.col("root")), merkle.proof_digest(F.col("path")), "folded", F.col("folded") == x(F.col("root")))
    return sorted((tuple(r) for r in rows.collect()), key=str)


def sample(seed: int, n: int) -> list[dict]:
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = r.choice([None, "", "é" * r.randrange(5), "a b\nc " * r.randrange(9), "x" * 100_000])
        rows.append({"doc_id": i * 3 + 1, "source": r.choice([None, "web", "Straße"]), "lang": r.choice(["en", "en", "en", None, "é", "Z", "one"] if i else ["single"]), "n_chars": None if r.random() < 0.2 else r.randrange(10**6), "text": text})
    return rows + [dict(rows[0]), dict(rows[0]), dict(rows[1]) | {"doc_id": None}, dict(rows[1]) | {"doc_id": None, "text": "other"}, dict(rows[2]) | {"text": "same id"}]


@pytest.mark.parametrize(("seed", "n", "arity"), [(1, 45, 2), (2, 16, 2), (3, 40, 3), (4, 30, 5)])
def test_equals_brute_force(spark, seed, n, arity):
    rows = sample(seed, n)
    random.Random(seed).shuffle(rows)
    assert results(frame(spark, rows).repartition(5), arity) == brute(rows, arity)


def test_one_leaf_one_language_and_none(spark):
    row = {"doc_id": 5, "source": None, "lang": None, "n_chars": None, "text": None}
    assert results(frame(spark, [row])) == brute([row], 2)
    assert results(frame(spark, [row]))[0][4] == H()
    assert results(frame(spark, []).limit(0)) == []
    with pytest.raises(ValueError):
        merkle.manifest(frame(spark, [row]), arity=1)
