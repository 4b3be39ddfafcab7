"""Key phrases against plain counting, on few and on all counters."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracelake.functions import phrases as H
from tracelake.operators import logtext as T


def plain(texts, least, most):
    found = Counter()
    for t in texts:
        w = [x for x in re.split("[^a-z0-9]+", t.lower()) if len(x) > 2] if t is not None else []
        grams = [tuple(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)]
        found.update(g for g in grams if not all(x in T.STOP for x in g))
    rows = [(" ".join(g), n, n * math.log(len(g) + 1)) for g, n in found.items() if n >= least]
    return [r[:2] for r in sorted(rows, key=lambda r: (-round(r[2], 9), r[0]))[:most]]


def some_texts():
    r, w = random.Random(5), ["the", "and", "von", "aa", "Ünd", "naïve", "x9y", "disk", "full", "retry", "Timeout", "extraordinarily"]
    texts = ["".join(r.choice(w) + r.choice([" ", ", ", "\n", "-", " é "]) for _ in range(r.randrange(40))) for _ in range(400)]
    return [*texts, None, "", "   ", "disk", "disk full", *["only here now"] * 3, *["rare twice"] * 2, "a" * 300 + " disk full"]


def test_key_phrases_equal_plain_counting(spark):
    texts = some_texts()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for least, most, first in ((3, 20, 2000), (3, 20, 1), (3, 5000, 2000), (1, 50, 10), (10_000, 20, 2000)):
        got = [(w.phrase, w["count"]) for w in T.key_phrases(df, F.col("text"), least, most, first).collect()]
        assert got == plain(texts, least, most), (least, most, first)


def test_only_phrases_that_can_reach_a_place_are_counted_one_by_one(spark):
    r = random.Random(6)
    texts = [" ".join([f"w{r.randrange(10**6):06d}" for _ in range(200)] + ["disk full again"] * 3) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    bounds = H.counters(df, 2, ("the",))
    assert bounds.sum() == sum(2 * (200 + 9) - 3 for _ in texts)
    chosen = bounds >= np.sort(bounds.reshape(-1))[-4]
    rows = H.phrases_on(df, 2, ("the",), chosen).collect()
    assert {w.phrase for w in rows} >= {"disk full", "full again"} and len({w.phrase for w in rows}) < 20
    assert T.key_phrases(df, F.col("text"), most=1).first()["count"] == 600
