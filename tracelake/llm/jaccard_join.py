"""N-gram Jaccard self-join with count-vector R-trees, and its components.

A document's set holds its distinct five-word shingles (64-bit hashes; sets are told apart by
128-bit digests). Shingles are hashed into groups, and a set's group counts are a point, with
more groups for larger sets. The overlap of two sets is at most the sum of their coordinate
minima, and the overlap of a set with any member of an R-tree node is at most the sum of minima
with the node's upper corner. Candidates come from searching such trees; only pairs that pass
the bound are verified on the sets themselves.

One tree over a whole corpus can't prune in so many dimensions, so points are indexed in
blocks: two sets of Jaccard similarity t or more share a shingle among the first
n - ceil(t n) + 1 of each, in any order that all documents keep. Shingles are ordered by their
counts in a fixed-size sketch of the whole corpus, the rare ones first, so that common passages
bring few documents together; blocks with the same members are one block.

Links matter for connectivity alone. First each tree is searched for the block's hub, the
member that shares most prefix shingles with others, and each set tries the strongest hub that
its trees gave it. Then, in blocks where sets of different components are left, the trees are
searched for every set outside the block's largest component; of the blocks that two sets share,
the one with the smallest shingle proposes them. No link between different components is lost,
and none within one is needed. Large blocks are dealt over several trees.

Defined cases: a document without words has an empty set, no links and its own component;
one with fewer than five words has its whole word sequence as one shingle; equal texts are
linked; repeated rows stay repeated; a row without an id takes the smallest id that it is linked
to, or null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_arrow, read, saved, text_key, without
from tracelake.llm.components import components, roots
from tracelake.llm.textops import Words, distinct_per_row, slices, texts_of

WORDS = 5
#: Similarity in hundredths.
PERCENT = 80
#: Coordinates of a point, as powers of two: those of small and of large sets.
LEAST_GROUPS, MOST_GROUPS = 4, 12
#: Members of an R-tree leaf, and children of its inner nodes.
FANOUT = 32
#: Members of one tree; larger blocks are dealt over several.
CHUNK = 2048
#: Counters of the sketch that orders shingles (a power of two), and the parts it is summed in.
COUNTERS, PARTS = 1 << 24, 64
#: Shingles that a task counts at a time.
COUNTED = 1 << 21
#: Digests that a task remembers, so that equal sets send one prefix.
REMEMBERED = 300_000
#: Sets that are looked for by every task; more are joined to their texts by a shuffle.
MOST_SENT = 200_000

_U = np.uint64


def required(na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of two linked sets of these sizes: ceil(p/(100+p) (na+nb))."""
    total = np.asarray(na, dtype=np.int64) + np.asarray(nb, dtype=np.int64)
    return -(-percent * total // (100 + percent))


def sets_of(texts: pa.LargeStringArray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row), distinct and ascending within each row."""
    h, row = Words(texts).grams(words)
    return distinct_per_row(h, row)


def level(n: np.ndarray) -> np.ndarray:
    """log2 of the coordinates of sets of these sizes: a set has one to two shingles a group."""
    bits = np.frexp(np.asarray(n, dtype=np.float64))[1] - 1
    return np.clip(bits, LEAST_GROUPS, MOST_GROUPS)


def point(shingles: np.ndarray, bits: int) -> bytes:
    """Group counts of one set, in bytes where they fit."""
    counts = np.bincount((shingles & _U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32).tobytes()


def folded(points: list[bytes], bits: int, fewer: int) -> np.ndarray:
    """Points of 2**bits coordinates with 2**fewer of them, a row each."""
    rows = [np.frombuffer(p, dtype=np.uint8 if len(p) == 1 << bits else np.int32) for p in points]
    return np.stack(rows).astype(np.int32).reshape(len(rows), -1, 1 << fewer).sum(axis=1)


class CountTree:
    """R-tree over count vectors: packed leaves by total and leading coordinates, upper corners above."""

    def __init__(self, points: np.ndarray):
        self.order = np.lexsort((*points.T[:4], points.sum(axis=1)))
        self.levels = [points[self.order]]
        while len(self.levels[-1]) > FANOUT:
            low = self.levels[-1]
            self.levels.append(np.maximum.reduceat(low, np.arange(0, len(low), FANOUT), axis=0))

    def search(self, query: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Members whose bound on the overlap reaches ``least`` (one value for each member, in the order of the points)."""
        least = least[self.order]
        floors = [least]
        for points in self.levels[1:]:
            floors.append(np.minimum.reduceat(floors[-1], np.arange(0, len(floors[-1]), FANOUT))[: len(points)])
        at = np.arange(len(self.levels[-1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            bound = np.minimum(self.levels[depth][at], query).sum(axis=1)
            at = at[bound >= floors[depth][at]]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1])]
        return self.order[at]


# sets and prefixes ----------------------------------------------------------------------


def shingle_ranks(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """How common the shingles of each of COUNTERS cells are, on a scale of bytes: COUNTERS bytes, whatever the corpus."""
    each = COUNTERS // PARTS
    parts_of, schema = ("part", "counts"), "part int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(COUNTERS, dtype=np.uint8), [], 0  # more than 255 in one task is common enough

        def add_up() -> None:
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            total[cells] = np.minimum(total[cells] + counts, 255)
            held.clear()

        for b in batches:
            texts = texts_of(b.column("text"))
            for lo, hi in slices(texts):
                held.append((sets_of(texts.slice(lo, hi - lo), words)[0] & _U(COUNTERS - 1)).astype(np.uint32))
                n += len(held[-1])
                if n > COUNTED:
                    add_up()
                    n = 0
        if held:
            add_up()
        parts = [zstandard.ZstdCompressor(level=1).compress(total[k * each : (k + 1) * each].tobytes()) for k in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], parts_of)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            scale = np.minimum(np.log2(1.0 + total) * 6, 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([scale.tobytes()], pa.binary())], parts_of)

        now, total = None, np.zeros(0, dtype=np.uint64)
        for b in batches:
            for i in range(b.num_rows):
                part, counts = b.column("part")[i].as_py(), np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column("counts")[i].as_py()), dtype=np.uint8)
                if part != now and now is not None:
                    yield row()
                total = total + counts if part == now else counts.astype(np.uint64)
                now = part
        if now is not None:
            yield row()

    rows = map_arrow(docs.select("text"), count, schema)
    sums = map_arrow(rows.repartition("part").sortWithinPartitions("part"), add, schema).toArrow()
    out = np.zeros(COUNTERS, dtype=np.uint8)
    for part, scale in zip(sums["part"].to_pylist(), sums["counts"].to_pylist(), strict=True):
        out[part * each : (part + 1) * each] = np.frombuffer(scale, dtype=np.uint8)
    return out


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _sets(b: pa.RecordBatch, words: int) -> Iterator[tuple]:
    """(first row, rows, shingles, their rows, first shingle of each row, digests as two columns) for the slices of a batch."""
    texts = texts_of(b.column("text"))
    for lo, hi in slices(texts):
        k = hi - lo
        h, row = sets_of(texts.slice(lo, k), words)
        at = np.searchsorted(row, np.arange(k + 1))
        digest = b"".join(xxhash.xxh3_128_digest(h[a:z].tobytes()) for a, z in zip(at[:-1], at[1:], strict=True))
        yield lo, k, h, row, at, np.frombuffer(digest, dtype=np.int64).reshape(k, 2)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), place (a hash of both) and text of every row."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), text_key(F.col("text")).alias("key"), F.xxhash64(doc_id, "text").alias("place"), "text")


def profiles(docs: DataFrame, ranks: np.ndarray, words: int, percent: int) -> DataFrame:
    """row, doc_id, key, place, n, d0, d1 (digest) of every row, and the prefix and point of each set that its task sees first."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ["doc_id", "key", "place", "n", "d0", "d1", "prefix", "point"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = shared.value, set()
        for b in batches:
            for lo, k, h, row, at, digest in _sets(b, words):
                n = np.diff(at)
                fresh = np.zeros(k, dtype=bool)
                for i, d in enumerate(map(tuple, digest.tolist())):
                    if n[i] and d not in known:
                        known.add(d)
                        fresh[i] = True
                if len(known) > REMEMBERED:
                    known.clear()
                order = np.lexsort((h, ranks[(h & _U(COUNTERS - 1)).astype(np.int64)], row))
                rank = np.arange(len(h)) - at[:-1][row]
                pick = (rank < prefix_size(n, percent)[row]) & fresh[row]
                ends = np.concatenate(([0], np.cumsum(np.bincount(row[pick], minlength=k)))).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[order][pick].view(np.int64)))
                points = pa.array([point(h[at[i] : at[i + 1]], bits) if fresh[i] else None for i, bits in enumerate(level(n).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, k) for c in names[:3]), pa.array(n), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), prefix, points], names)

    rows = map_arrow(rows_of(docs), run, "doc_id long, key string, place long, n long, d0 long, d1 long, prefix array<long>, point binary")
    return rows.withColumn("row", F.monotonically_increasing_id())


def repeated_rows(rows: DataFrame) -> DataFrame:
    """row of every set that an earlier row's task has sent already."""
    own = rows.filter("point is not null").select("row", "d0", "d1")
    first = own.groupBy("d0", "d1").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").select("d0", "d1", "first")
    return saved(own.join(first, ["d0", "d1"]).filter("row <> first").select("row"))


def blocks_of(rows: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, place, n, d0, d1, point of the sets that share a prefix shingle with another; blocks: token, id, size, times).

    Blocks of the same members are one, ``times`` says of how many shingles; blocks of two sets
    whose sizes can't be linked are none. A shingle that many sets share is counted before it
    is shuffled, and its rows are not gathered anywhere.
    """
    extra = repeated_rows(rows)
    sets = rows.filter("point is not null").join(F.broadcast(extra) if extra.count() <= MOST_SENT else extra, "row", "left_anti")
    prefixes = sets.select(F.explode("prefix").alias("token"), F.col("row").alias("id"))
    shared = prefixes.groupBy("token").agg(F.count("*").alias("rows")).filter("rows > 1").select("token")
    found = saved(prefixes.join(shared.hint("shuffle_hash"), "token"))
    near = found.join(rows.select(F.col("row").alias("id"), "n"), "id")
    signs = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"s{k}") for k in range(2)]
    tokens = near.groupBy("token").agg(F.count("*").alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi"), *signs).filter(f"size > 2 or 100 * lo >= {percent} * hi")
    one = tokens.groupBy("size", "s0", "s1").agg(F.min("token").alias("token"), F.count("*").alias("times")).select("token", "size", "times")
    blocks = saved(found.join(one, "token"))
    nodes = rows.select(F.col("row").alias("id"), "place", "n", "d0", "d1", "point").join(blocks.select("id").distinct(), "id", "left_semi")
    return saved(nodes), blocks


def sets_table(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id and shingles of the wanted nodes, each once."""
    rows = rows_of(docs).select("place", "text").join(F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted, "place").select("id", "d0", "d1", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # rows of one id and one text give the same set
        for b in batches:
            for lo, k, h, _, at, digest in _sets(b, words):
                ids = b.column("id").slice(lo, k)
                own = (digest == np.stack([b.column(c).slice(lo, k).to_numpy() for c in ("d0", "d1")], axis=1)).all(axis=1)
                for i, x in enumerate(ids.to_pylist()):
                    own[i] &= x not in sent
                    if own[i]:
                        sent.add(x)
                sets = pa.array([h[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, sets], ["id", "shingles"]).filter(pa.array(own))

    out = saved(map_arrow(rows, run, "id long, shingles binary").withColumn("part", F.spark_partition_id()))
    again = saved(out.groupBy("id").agg(F.min("part").alias("keep"), F.count("*").alias("n")).filter("n > 1").select("id", "keep"))
    if not again.isEmpty():
        out = out.join(again, "id", "left").filter("keep is null or keep = part")
    return out.select("id", "shingles")


# links ----------------------------------------------------------------------------------


def dealt(blocks: DataFrame, queries: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of trees (token, part): each member once, each query (token, id, label, size) in every part of its block."""
    parts = F.ceil(F.col("size") / CHUNK).cast("int")
    members = blocks.select("token", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(False).alias("query"), "id", "label")
    asked = queries.select("token", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("query"), "id", "label")
    return members.unionByName(asked).join(points, "id")


def apart(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the others have no number in common with ``own``, which ascends."""
    out = np.ones(len(others), dtype=bool)
    if len(own) and len(others):
        flat = np.concatenate(others)
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        out[np.repeat(np.arange(len(others)), [len(x) for x in others])[hit]] = False
    return out


def searched(trees: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a query and a member of another label that pass the bound of the tree over the members.

    Where rows say which ``earlier`` blocks hold them, pairs that share one are left to it.
    """
    names = ("token", "part", "query", "id", "label", "n")
    lists = ("point", "earlier") if "earlier" in trees.columns else ("point",)

    def pairs_of(r: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, bits, asked = r["n"], level(r["n"]), r["query"]
        for k in np.unique(bits[~asked]).tolist():
            m = np.flatnonzero(~asked & (bits == k))
            low, high = percent * int(n[m].min()), int(n[m].max()) * 100
            for j in (k - 1, k, k + 1):  # linked sets differ by a level at most
                q = np.flatnonzero(asked & (bits == j) & (100 * n >= low) & (percent * n <= high))
                if not len(q):
                    continue
                few = min(j, k)
                tree = CountTree(folded([r["point"][i] for i in m], k, few))
                for x, p in zip(q.tolist(), folded([r["point"][i] for i in q], j, few), strict=True):
                    y = m[tree.search(p, required(n[x], n[m], percent))]
                    y = y[(r["label"][y] != r["label"][x]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))]
                    if "earlier" in r:
                        y = y[apart(r["earlier"][x], [r["earlier"][i] for i in y])]
                    if len(y):
                        yield np.full(len(y), r["id"][x]), r["id"][y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def finish() -> None:
            if held and any(x["query"].any() for x in held):
                rows = {c: np.concatenate([x[c] for x in held]) for c in names}
                rows |= {c: [v for x in held for v in x[c]] for c in lists}
                for x, y in pairs_of(rows):
                    a.append(x)
                    b.append(y)
            held.clear()

        def flush() -> pa.RecordBatch:
            out = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            values = {"point": batch.column("point").to_pylist()}
            if "earlier" in lists:
                given = batch.column("earlier")
                values["earlier"] = np.split(given.flatten().to_numpy(), np.cumsum(given.value_lengths().to_numpy())[:-1])
            new = (rows["token"][1:] != rows["token"][:-1]) | (rows["part"][1:] != rows["part"][:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if held and (held[0]["token"][0], held[0]["part"][0]) != (rows["token"][lo], rows["part"][lo]):
                    finish()
                held.append({c: v[lo:hi] for c, v in (rows | values).items()})
            if a:
                yield flush()
        finish()
        if a:
            yield flush()

    ordered = trees.select(*names, *lists).repartition("token", "part").sortWithinPartitions("token", "part")
    return map_arrow(ordered, run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; only their sets are made and shuffled."""
    pairs = saved(pairs)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = sets_table(docs, saved(nodes.select("id", "place", "d0", "d1").join(wanted, "id", "left_semi")), words)
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(rows, run, "a long, b long")


def near_hubs(blocks: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a: hub, b) that pass the bound in a block's tree, with the hub's strength: the prefix shingles it shares, over all its blocks."""
    strength = blocks.groupBy("id").agg(F.sum(F.col("size") * F.col("times")).alias("strength"))
    own = blocks.withColumn("label", F.col("id"))
    hubs = blocks.join(strength, "id").groupBy("token").agg(F.max(F.struct("strength", "id", "size")).alias("h"))
    hubs = hubs.select("token", F.col("h.id").alias("id"), F.col("h.id").alias("label"), F.col("h.size").alias("size"))
    return searched(dealt(own, hubs, points), percent).distinct().join(strength.withColumnRenamed("id", "a"), "a")


def hub_pairs(near: DataFrame) -> DataFrame:
    """A pair (a: hub, b) for each set: the strongest of the hubs whose searches reached it. A hub is stronger than what it reaches, so the pairs are a forest."""
    return near.groupBy("b").agg(F.max(F.struct("strength", "a")).alias("h")).select("h.a", "b")


def outside(blocks: DataFrame, labels: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a: outside its block's largest component, b) of different components that pass the bound, each from one of its blocks of more than two.

    Of two sets of different components one is outside the largest in every block of both, so
    it is their first block that proposes them.
    """
    marked = blocks.filter("size > 2").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    parts = marked.groupBy("token", "label").agg(F.count("*").alias("c"))
    largest = parts.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels")).filter("labels > 1").select("token", F.col("m.label").alias("largest"))
    mixed = saved(marked.join(largest, "token"))
    places = mixed.groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    trees = dealt(mixed, mixed.filter("label <> largest"), points.join(places, "id"))
    return searched(trees.withColumn("earlier", F.filter("tokens", lambda t: t < F.col("token"))), percent)


def other_pairs(blocks: DataFrame, near: DataFrame, labels: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of different components that pass the bound.

    Those with a hub are known; in blocks of more than two, all sets outside the block's
    largest component are searched for.
    """
    labels = labels.withColumnRenamed("node", "id")
    found = outside(blocks, labels, points, percent)
    end = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"_{side}"))
    known = near.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
    every = found.union(known.select("a", "b"))
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(profiles of every row; d0, d1, label of every set that has links)."""
    rows = saved(profiles(docs, shingle_ranks(docs, words), words, percent))
    nodes, blocks = blocks_of(rows, percent)
    points = nodes.select("id", "n", "point")
    near = saved(near_hubs(blocks, points, percent))
    first = roots(verified(hub_pairs(near), docs, nodes, words, percent))
    more = saved(verified(other_pairs(blocks, near, first, points, percent), docs, nodes, words, percent))
    # links that are left join whole components
    up = lambda side: first.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    every = nodes.join(first, nodes["id"] == first["node"], "left").select("d0", "d1", F.coalesce("label", "id").alias("first"))
    if more.isEmpty():
        return rows, every.withColumnRenamed("first", "label")
    more = more.join(up("a"), "a", "left").join(up("b"), "b", "left")
    second = components(more.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    over = second.select(F.col("node").alias("first"), F.col("label").alias("second"))
    return rows, every.join(over, "first", "left").select("d0", "d1", F.coalesce("second", "first").alias("label"))


def _first(doc_id: str, key: str) -> Column:
    """Orders rows by id, those without one last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(key).alias("key"))


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n, lead (none, doc_id, key of the class's first row) of every row; lead is null for rows without words."""
    rows, labels = linked(docs, words, percent)
    rows = rows.select("doc_id", "key", "n", "d0", "d1")
    each = rows.filter("n > 0").groupBy("d0", "d1").agg(F.min(_first("doc_id", "key")).alias("own"), F.count("*").alias("c")).join(labels, ["d0", "d1"], "left")
    heads = each.filter("label is not null").groupBy("label").agg(F.min("own").alias("head"))
    found = each.filter("c > 1 or label is not null").join(heads, "label", "left").select("d0", "d1", F.coalesce("head", "own").alias("lead"))
    out = rows.join(found, ["d0", "d1"], "left")
    return out.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.coalesce("lead", _first("doc_id", "key"))).alias("lead"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return classes(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("lead.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that another row of their component replaces.

    The smallest id stays; a row is told by its id and its text, and of identical rows one stays.
    Rows without words aren't copies of anything and stay, all of them.
    """
    found = classes(docs, words, percent).filter("lead is not null")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    return without(docs, found.groupBy("doc_id", "key").agg(F.min(own.eqNullSafe(F.col("lead"))).alias("kept"), F.count("*").alias("times")))


def query(spark, sf_dir):
    return join(read(spark, sf_dir, "documents"))
