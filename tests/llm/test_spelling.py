"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tracelake.llm import spelling


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute(rows, every=spelling.DAMAGED):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}
    of = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in of.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), c, len(of[w]), n[form[w]] if w in form else None) for w, c in n.items())


def text_of(r: random.Random, words: list[str], size: int) -> str:
    out = []
    for _ in range(size):
        w = r.choice(words)
        if r.random() < 0.3:
            at = r.randrange(len(w) + 1)
            w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("aé×ß") + w[at:], w[:at] + r.choice("bÀ") + w[at + 1 :]])
        out.append(r.choice([w, w, w.upper(), w.capitalize()]))
    return "".join(w + r.choice([" ", ", ", "\n", "1", "Ā", "-"]) for w in out)


def got(spark, df, every):
    return sorted((w.word, w.form, w.root, w.n, w.n_near, w.form_n) for w in spelling.variants(spelling.word_counts(df, every)).collect())


def test_equals_brute_force(spark, documents):
    for seed, every in ((1, 199), (2, 7)):
        r = random.Random(seed)
        words = ["aaaaaa", "abcabc", "houses", "straße", "Élégante", "größere", "documents", "internationalisation"]
        words += [w[:3] + w[4:] + "s" for w in words]
        rows = [(i * 7, text_of(r, words, r.randrange(90))) for i in range(60)]
        rows += [(3, None), (4, ""), (None, text_of(r, words, 60)), (None, rows[5][1]), rows[6], rows[6], (9, "12 ... Ā"), (11, text_of(r, words, 9000))]
        have = got(spark, documents(rows, 4).withColumns({c: F.lit("x") for c in ("word", "form", "root", "half", "gram", "length")}), every)
        assert have == brute(rows, every) and len(have) > 50
        assert any(w[1] for w in have)  # chains of forms have a test of their own


def test_chains_ties_and_nothing(spark, documents):
    words = spark.createDataFrame([("abcdef", 5), ("abcdefg", 25), ("abcdefgh", 125), ("abcdefghi", 625), ("zzzzzz", 7), ("zzzzzy", 40), ("zzzzzx", 40)], "word string, n long")
    rows = {w.word: w for w in spelling.variants(words).collect()}
    assert rows["abcdef"].root == "abcdefghi" and rows["abcdef"].form == "abcdefg"
    assert rows["zzzzzz"].form == "zzzzzx" and rows["zzzzzx"].form is None and rows["zzzzzx"].n_near == 2
    assert spelling.variants(spelling.word_counts(documents([]))).count() == 0


def test_every_pair_once(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(6, 9))) for _ in range(150)})
    pairs = [(p.a, p.b) for p in spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if near(a, b))


def test_long_texts_are_read_in_steps(monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 3)
    assert spelling.runs("ABC déf abc ÉÀ".encode()) == Counter({"abc": 2, "déf": 1, "ÉÀ": 1})
