"""Benchmark decontamination by greedy string tiling.

Words are compared without case and punctuation. Runs of ``SEED`` words of a document that
also stand in a benchmark item make the pair a candidate; an item whose seeds cannot cover
``COVERAGE`` of its words is left out, which loses nothing, as every tile consists of seeds.
For the others greedy tiling marks the longest common runs, found by running Karp-Rabin
hashes whose length is halved down to, none overlapping another; a document whose tiles cover at least
``COVERAGE`` of an item's words is contaminated, in whatever order the passages stand.

The benchmark goes to the tasks in blocks of bounded size, one pass over the documents each.

Defined cases: null and empty texts and items match nothing; items with fewer than ``SEED``
words match only where all their words stand in a row; repeated rows stay repeated; an empty
benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import MOST_SENT, fresh, map_arrow, read, small_or_shuffled
from tracelake.llm.textops import PLAIN, Words, powers, slices, texts_of, window_hash

SEED = 4
COVERAGE = 0.6
#: Characters of benchmark text that one pass over the documents carries.
BLOCK_CHARS = 16_000_000

_U = np.uint64


class Items:
    """Benchmark items of one block: word hashes, and which items hold each different seed."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words(texts_of(pa.array(texts, pa.string())), PLAIN)
        keep = np.flatnonzero(np.diff(words.first) > 0)
        self.ids = np.array(ids, dtype=np.int64)[keep]
        self.words = [words.hash[words.first[i] : words.first[i + 1]] for i in keep]
        # items that are shorter than a seed are sought as a whole
        self.short: dict[int, list[int]] = {}
        none = np.zeros(0, dtype=np.uint64)
        self.seeds = [windows(w, SEED) for w in self.words]
        for k, w in enumerate(self.words):
            if len(w) < SEED:
                self.short.setdefault(len(w), []).append(k)
        each = [np.unique(g) for g in self.seeds]
        seed = np.concatenate(each) if each else none
        owner = np.repeat(np.arange(len(each)), [len(g) for g in each])
        order = np.argsort(seed, kind="stable")
        self.owner = owner[order]
        self.seed, first = np.unique(seed[order], return_index=True)
        self.first = np.append(first, len(seed))
        self.bits = max(16, int(len(self.seed) * 16).bit_length())
        self.mask = np.zeros(1 << self.bits, dtype=bool)
        self.mask[(self.seed & _U((1 << self.bits) - 1)).astype(np.int64)] = True


def running(words: np.ndarray) -> np.ndarray:
    """Sums from which the Karp-Rabin hash of any run of words follows in one step."""
    up, _ = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], dtype=np.uint64, out=sums[1:])
    return sums


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words."""
    return hash_at(running(words), np.arange(max(0, len(words) - n + 1)), n)


def hash_at(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return window_hash(sums, at, n) if len(at) else np.zeros(0, dtype=np.uint64)


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (text start, item start, length), the longest first, none overlapping.

    A common run of n words holds one of n - 1, so the longest length that free words of both
    share is found by halving; its runs are placed in the item's order, each at the first free
    place of the text.
    """
    free_t, free_i = np.ones(len(text), dtype=bool), np.ones(len(item), dtype=bool)
    sums_t, sums_i = running(text), running(item)
    out: list[tuple[int, int, int]] = []

    def runs(n: int) -> tuple[np.ndarray, ...]:
        at_t, at_i = _free_runs(free_t, n), _free_runs(free_i, n)
        return at_t, hash_at(sums_t, at_t, n), at_i, hash_at(sums_i, at_i, n)

    def shared(n: int) -> bool:
        _, h_t, _, h_i = runs(n)
        return bool(np.isin(h_i, h_t).any())

    high = min(len(text), len(item))
    while high >= least and shared(least):
        low = least
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if shared(n) else (low, n - 1)
        n, placed = low, False
        at_t, h_t, at_i, h_i = runs(n)
        order = np.argsort(h_t, kind="stable")
        h_t, at_t = h_t[order], at_t[order]
        start, end = np.searchsorted(h_t, h_i, side="left"), np.searchsorted(h_t, h_i, side="right")
        following: dict[int, int] = {}
        for j, h, a, z in zip(at_i.tolist(), h_i.tolist(), start.tolist(), end.tolist(), strict=True):
            if a == z or not free_i[j : j + n].all():
                continue
            k = following.get(h, a)
            while k < z:
                i = int(at_t[k])
                k += 1
                if free_t[i : i + n].all() and np.array_equal(text[i : i + n], item[j : j + n]):
                    free_t[i : i + n] = free_i[j : j + n] = False
                    out.append((i, j, n))
                    placed = True
                    break
            following[h] = k
        high = n if placed else n - 1
    return out


def _free_runs(free: np.ndarray, n: int) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(sums[n:] - sums[:-n] == n) if len(free) >= n else np.zeros(0, dtype=np.int64)


def coverage(words: np.ndarray, places: np.ndarray, seeds: np.ndarray, items: Items, least: float) -> tuple[float, int, int] | None:
    """(coverage, -item id, tiles) of the item that the document covers best, if any reaches ``least``.

    places: where the document's words begin a seed; seeds: the numbers of those seeds.
    """
    best = None
    held = np.unique(seeds)
    n = items.first[held + 1] - items.first[held]
    owners = items.owner[np.repeat(items.first[held], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    for k, c in zip(*np.unique(owners, return_counts=True), strict=True):
        item = items.words[k]
        if c * SEED < least * len(item) and len(np.unique(items.seeds[k])) == len(items.seeds[k]):
            continue
        mine = np.isin(items.seeds[k], items.seed[held])
        reach = np.convolve(mine, np.ones(SEED, dtype=np.int64)) > 0
        if reach.sum() < least * len(item):
            continue
        here = places[np.isin(items.seed[seeds], items.seeds[k])]
        near = np.zeros(len(words), dtype=bool)  # only words inside seeds can be in a tile
        for s in range(SEED):
            near[here + s] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], near.view(np.int8), [0]))))
        parts, gap = [], np.zeros(1, dtype=np.uint64)
        for a, z in zip(edges[0::2], edges[1::2], strict=True):
            parts += [words[a:z], gap]
        found = tiles(np.concatenate(parts), item, SEED)
        share = sum(x[2] for x in found) / len(item)
        if share >= least:
            best = max(best or (0.0, -(1 << 62), 0), (share, -int(items.ids[k]), len(found)))
    return best


def scan_block(docs: DataFrame, items: Items, least: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        low = _U((1 << items.bits) - 1)
        for b in batches:
            texts = texts_of(b.column("text"))
            best: list[tuple[float, int, int] | None] = [None] * len(texts)
            for lo, hi in slices(texts):
                w = Words(texts.slice(lo, hi - lo), PLAIN)
                g = windows(w.hash, SEED)
                ok = w.doc[: len(g)] == w.doc[SEED - 1 :] if len(g) else np.zeros(0, dtype=bool)
                at = np.flatnonzero(ok & items.mask[(g & low).astype(np.int64)])
                if len(at) and len(items.seed):
                    known = np.minimum(np.searchsorted(items.seed, g[at]), len(items.seed) - 1)
                    same = items.seed[known] == g[at]
                    at, known = at[same], known[same]
                    doc = w.doc[at]
                    cut = np.flatnonzero(np.diff(doc)) + 1
                    for a, z in zip([0, *cut], [*cut, len(doc)], strict=True) if len(doc) else ():
                        d, s = doc[a], w.first[doc[a]]
                        best[lo + d] = coverage(w.hash[s : w.first[d + 1]], at[a:z] - s, known[a:z], items, least)
                for size, who in items.short.items():
                    g = windows(w.hash, size)
                    ok = w.doc[: len(g)] == w.doc[size - 1 :] if len(g) else np.zeros(0, dtype=bool)
                    for k in who:
                        for d in np.unique(w.doc[: len(g)][ok & (g == windows(items.words[k], size)[0])]):
                            best[lo + d] = max(best[lo + d] or (0.0, -(1 << 62), 0), (1.0, -int(items.ids[k]), 1))
            share = [x[0] if x else None for x in best]
            item = [-x[1] if x else None for x in best]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array([x[2] if x else 0 for x in best], pa.int32()), b.column("digest")], ["doc_id", "item_id", "coverage", "n_tiles", "digest"])

    return map_arrow(rows_of(docs), run, "doc_id long, item_id long, coverage double, n_tiles int, digest string")


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and digest of every row; the last tells apart rows that share an id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2(F.col("text"), 256).alias("digest"))


def blocks_of(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """Items in blocks of about ``chars`` characters; one block is on the driver at a time."""
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield Items(part["item_id"].to_pylist(), part["text"].to_pylist())


def best_items(docs: DataFrame, benchmark: DataFrame, least: float, chars: int) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, digest of every row, whatever the number of blocks."""
    found = [scan_block(docs, items, least) for items in blocks_of(benchmark, chars)]
    if len(found) == 1:
        return found[0]
    hits = found[0].filter("item_id is not null")
    for more in found[1:]:
        hits = hits.unionByName(more.filter("item_id is not null"))
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("i"), "n_tiles")).alias("b")
    hits = hits.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(best)
    out = rows_of(docs).select("doc_id", "digest").join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest")), "left")
    return out.select("doc_id", (-F.col("b.i")).alias("item_id"), "b.coverage", F.coalesce("b.n_tiles", F.lit(0)).alias("n_tiles"), "digest")


def scan(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, contaminated, item_id, coverage, n_tiles: a row per document, with the item it covers best."""
    out = best_items(docs, benchmark, least, chars)
    return out.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "n_tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item; a row is told by its id and its text."""
    hit_id, hit_digest = fresh(docs, "_hit_id"), fresh(docs, "_hit_digest")
    hit = best_items(docs, benchmark, least, chars).filter("item_id is not null").select(F.col("doc_id").alias(hit_id), F.col("digest").alias(hit_digest)).distinct()
    hit = small_or_shuffled(hit, MOST_SENT)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(hit_id)) & F.sha2(docs["text"], 256).eqNullSafe(F.col(hit_digest))
    return docs.join(hit, same, "left_anti").select(docs.columns)


def query(spark, sf_dir):
    return scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
