"""Greedy string tiling: each tile is the longest that is left, whatever the words."""

import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import decontaminate


def longest(text, item, free_t, free_i):
    best = 0
    row = [0] * (len(item) + 1)
    for i in range(len(text)):
        now = [0] * (len(item) + 1)
        for j in range(len(item)):
            if text[i] == item[j] and free_t[i] and free_i[j]:
                now[j + 1] = row[j] + 1
                best = max(best, now[j + 1])
        row = now
    return best


words = st.lists(st.integers(1, 3), min_size=0, max_size=40).map(lambda x: np.array(x, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@given(words, words, st.integers(2, 4))
@settings(max_examples=150, deadline=None)
def test_each_tile_is_the_longest(text, item, least):
    free_t, free_i = [True] * len(text), [True] * len(item)
    for i, j, n in decontaminate.tiles(text, item, least):
        assert n == longest(text, item, free_t, free_i) and text[i : i + n].tolist() == item[j : j + n].tolist()
        assert all(free_t[i : i + n]) and all(free_i[j : j + n])
        free_t[i : i + n] = free_i[j : j + n] = [False] * n
    assert longest(text, item, free_t, free_i) < least


def test_one_repeated_word(spark):
    docs = spark.createDataFrame([(0, "ha " * 200_000), (1, "ha ha " * 3), (2, "ho " * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "ha " * 300), (8, "ha ha ha"), (9, "ha " * 5)], "item_id long, text string")
    began = time.time()
    out = {r.doc_id: (r.contaminated, r.item_id) for r in decontaminate.scan(docs, bench).collect()}
    assert out == {0: (True, 7), 1: (True, 8), 2: (False, None)} and time.time() - began < 60
