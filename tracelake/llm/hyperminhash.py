"""Near-duplicate classes by HyperMinHash sketches, banding and verification.

A document's set holds its distinct four-word shingles. A shingle's hash chooses one of 128
buckets; a bucket keeps, of the smallest of its hashes, the number of leading zeros (5 bits) and
the 11 bits after the first one: 16 bits a register, 256 bytes a set, whatever its size. A bucket
without shingles takes the register of the first bucket with one in an order of its own, so
small sets have full sketches too.

Registers are banded by fours. Two sets of similarity 0.8 share none of 32 bands once in 20
million times. Sets that share a band meet in a block. The share of equal registers, corrected
for those that collide by chance, estimates the similarity; pairs more than ``SIGMAS`` standard
errors below the threshold are left out (at 0.8 that is 0.59), the others are verified on their
full sets. Sets of fewer than four shingles can only be linked with equal ones.

Links matter for connectivity alone. First every set is compared with one hub, the strongest
member of its blocks. In blocks that then hold sets of different components, tasks that hold one
part of a block at a time compare the sets outside the largest component with all the others:
twice each set proposes its most similar one only, which joins nearly all that belongs together,
then every pair is proposed that the estimate and the exact bound of group counts (the sum of
minima of how many shingles fall into each group) allow. A pair is proposed in the first of its
bands only. Blocks so large that dealing them over parts would cost more are banded again,
within themselves, on other registers. Equal sets are one set throughout.

Defined cases: a document without words has an empty set, no links and its own component; one
with fewer than four words has its whole word sequence as one shingle; equal texts are linked;
repeated rows stay repeated; a row without an id takes the smallest id that it is linked to, or
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_arrow, read, saved
from tracelake.llm.components import components, roots
from tracelake.llm.jaccard_join import MOST_SENT, REMEMBERED, _sets, folded, level, point, repeated_rows, required, rows_of, verified
from tracelake.llm.textops import mix

WORDS = 4
#: Similarity in hundredths.
PERCENT = 80
#: Registers (a power of two), and those of a band.
BUCKETS, ROWS = 128, 4
#: Bits of a register: leading zeros, then mantissa.
ZEROS, MANTISSA = 5, 11
#: Standard errors that an estimate may lie below the threshold.
SIGMAS = 6
#: Members of a block that one task compares at a time.
CHUNK = 8192
#: Parts beyond which a block is banded again, and how often.
PARTS, AGAIN = 32, 3
#: Rounds in which each set proposes its most similar one.
NEAREST = 2

_U = np.uint64
_BUCKET_BITS = BUCKETS.bit_length() - 1
#: Each bucket's order of the others, from which it borrows where it is empty.
_ORDER = np.stack([np.random.default_rng(20240301 + k).permutation(BUCKETS) for k in range(BUCKETS)])
#: Bands of the first round, and those of each further one on other groups of registers.
_BANDS = [np.arange(BUCKETS).reshape(-1, ROWS)] + [np.random.default_rng(20240401 + k).permutation(BUCKETS).reshape(-1, ROWS) for k in range(AGAIN)]


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 128 registers of one set of hashes: (leading zeros << 11) + mantissa of each bucket's smallest."""
    h = mix(shingles.astype(np.uint64))
    bucket = (h >> _U(64 - _BUCKET_BITS)).astype(np.int64)
    rest = h << _U(_BUCKET_BITS)
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, bucket, rest)
    full = np.zeros(BUCKETS, dtype=bool)
    full[bucket] = True
    most = (1 << ZEROS) - 1
    zeros = np.zeros(BUCKETS, dtype=np.int64)
    left = least.copy()
    for step in (16, 8, 4, 2, 1):
        low = left < (_U(1) << _U(64 - step))
        zeros += np.where(low, step, 0)
        left = np.where(low, left << _U(step), left)
    mantissa = ((left << _U(1)) >> _U(64 - MANTISSA)).astype(np.int64)  # the bits after the first one
    out = ((np.minimum(zeros, most) << MANTISSA) | mantissa).astype(np.uint16)
    if full.all() or not full.any():
        return out
    return np.where(full, out, out[_ORDER[np.arange(BUCKETS), full[_ORDER].argmax(axis=1)]])


def collisions(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How likely registers of two disjoint sets of these sizes are equal.

    The smallest hashes of a bucket are spread like exponential times with rates na and nb; a
    register tells apart steps whose width is x / (2 ln 2) * 2**-mantissa on average at x.
    """
    na, nb = np.asarray(na, dtype=np.float64), np.asarray(nb, dtype=np.float64)
    return na * nb / (na + nb) ** 2 / (2 * np.log(2)) / (1 << MANTISSA)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches (a row each) of sets of these sizes."""
    same, chance = (a == b).mean(axis=-1), collisions(na, nb)
    return (same - chance) / (1 - chance)


def floor_of(percent: int) -> float:
    """The least estimate that is verified."""
    j = percent / 100
    return j - SIGMAS * np.sqrt(j * (1 - j) / BUCKETS)


def bands(sketches: np.ndarray, again: int = 0) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    groups = _BANDS[again]
    r = sketches[:, groups].astype(np.uint64)
    key = np.zeros(r.shape[:2], dtype=np.uint64)
    for k in range(ROWS):
        key = (key << _U(16)) | r[:, :, k]
    return mix(mix(key) + np.arange(len(groups), dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)


# sets and blocks ------------------------------------------------------------------------


def profiles(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """row, doc_id, key, place, n, d0, d1 (digest) of every row, and the sketch and group counts of each set that its task sees first."""
    names = ["doc_id", "key", "place", "n", "d0", "d1", "point", "counts"]
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # smaller sets are linked with equal ones only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for b in batches:
            for lo, k, h, _, at, digest in _sets(b, words):
                n, points, counts = np.diff(at), [], []
                for i, d in enumerate(map(tuple, digest.tolist())):
                    new = n[i] >= least and d not in known
                    if new:
                        known.add(d)
                    own = h[at[i] : at[i + 1]]
                    points.append(registers(own).tobytes() if new else None)
                    counts.append(point(own, int(level(n[i]))) if new else None)
                if len(known) > REMEMBERED:
                    known.clear()
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, k) for c in names[:3]), pa.array(n), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(points, pa.binary()), pa.array(counts, pa.binary())], names)

    rows = map_arrow(rows_of(docs), run, "doc_id long, key string, place long, n long, d0 long, d1 long, point binary, counts binary")
    return rows.withColumn("row", F.monotonically_increasing_id())


def banded(sets: DataFrame, again: int = 0) -> DataFrame:
    """token, band (its number), id of each band of (id, point); where the sets have a block already, a band counts within it and has no number (-1)."""
    inside = "block" in sets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = bands(_sketches(b.column("point")), again)
            if inside:
                keys = mix(keys.view(np.uint64) ^ mix(b.column("block").to_numpy().view(np.uint64))[:, None]).view(np.int64)
            ids = np.repeat(b.column("id").to_numpy(), keys.shape[1])
            number = np.tile(np.full(keys.shape[1], -1) if inside else np.arange(keys.shape[1]), len(keys)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(number), pa.array(ids)], ["token", "band", "id"])

    return map_arrow(sets.select("id", "point", *(["block"] if inside else [])), run, "token long, band int, id long")


def blocks_of(tokens: DataFrame) -> DataFrame:
    """token, band, id, size of the tokens of two sets or more; of blocks with the same members the one of the first band stays."""
    tokens = saved(tokens)
    signs = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"s{k}") for k in range(2)]
    shared = tokens.groupBy("token").agg(F.first("band").alias("band"), F.count("*").alias("size"), *signs).filter("size > 1")
    one = shared.groupBy("size", "s0", "s1").agg(F.min(F.struct("band", "token")).alias("k")).select("k.token", "size")
    return saved(tokens.join(one, "token"))


# links ----------------------------------------------------------------------------------


def hub_pairs(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A pair (a: hub, b) for each set: the strongest member of its blocks, if the estimate allows it.

    A set's strength is the sum of its blocks' sizes. Hubs are stronger than what they reach, so
    the pairs are a forest.
    """
    strength = blocks.groupBy("id").agg(F.sum("size").alias("strength"))
    known = blocks.select("token", "id").join(strength, "id").select("token", F.struct("strength", "id").alias("own"))
    hubs = known.groupBy("token").agg(F.max("own").alias("hub"))
    best = known.join(hubs, "token").groupBy(F.col("own.id").alias("b")).agg(F.max("hub").alias("hub"))
    pairs = best.select(F.col("hub.id").alias("a"), "b").filter("a <> b")
    return estimated(pairs, sets, percent)


def estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and estimates allow a link."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"p_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    least = floor_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                j = similarity(_sketches(b.column("p_a")), _sketches(b.column("p_b")), b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(j >= least))

    return map_arrow(rows.select("a", "b", "n_a", "n_b", "p_a", "p_b"), run, "a long, b long")


def parted(blocks: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """The blocks, where those beyond ``most`` members are banded again within themselves."""
    done = blocks.filter(F.col("size") <= most)
    large = blocks.filter(F.col("size") > most)
    for again in range(1, AGAIN + 1):
        if large.isEmpty():
            return done
        inner = large.select(F.col("token").alias("block"), "id").join(sets.select("id", "point"), "id")
        now = blocks_of(banded(inner, again)).select(*blocks.columns)
        done, large = done.unionByName(now.filter(F.col("size") <= most)), now.filter(F.col("size") > most)
    return done.unionByName(large)


def mixed(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """token, band, id, size, label, asked of blocks with several components; all outside a block's largest one are asked about."""
    marked = blocks.join(labels.withColumnRenamed("node", "id"), "id")
    parts = marked.groupBy("token", "label").agg(F.count("*").alias("c"))
    largest = parts.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels")).filter("labels > 1").select("token", F.col("m.label").alias("largest"))
    return saved(marked.join(largest, "token").select("token", "band", "id", "size", "label", (F.col("label") != F.col("largest")).alias("asked")))


def compared(blocks: DataFrame, sets: DataFrame, percent: int, chunk: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different labels that sizes and estimates allow, one of them asked about.

    ``nearest``: of each asked set the most similar one. Otherwise a < b, all that the bound of
    the group counts allows as well; a pair is found in the first band it has in common.
    """
    parts = F.ceil(F.col("size") / chunk).cast("int")
    members = blocks.select("token", "band", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(False).alias("query"), "id", "label")
    asked = blocks.filter("asked").select("token", "band", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("query"), "id", "label")
    extra = [] if nearest else ["counts"]
    rows = members.unionByName(asked).join(sets.select("id", "n", "point", *extra), "id")
    names, least = ("query", "id", "label", "n", "band"), floor_of(percent)

    def bounded(q: int, at: np.ndarray, n: np.ndarray, counts: list[bytes]) -> np.ndarray:
        """Of the rows ``at`` those whose group counts allow enough overlap with row q."""
        bits, own, out = level(n[at]), int(level(n[q])), np.zeros(len(at), dtype=bool)
        for k in np.unique(bits).tolist():
            few, there = min(k, own), bits == k
            mine = folded([counts[q]], own, few)
            out[there] = np.minimum(folded([counts[i] for i in at[there]], k, few), mine).sum(axis=1) >= required(n[at[there]], n[q], percent)
        return at[out]

    def pairs_of(held: list[pa.Table]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        t = pa.concat_tables(held)
        c = {x: t.column(x).to_numpy() for x in names}
        m = np.flatnonzero(~c["query"])
        asked = np.flatnonzero(c["query"])
        if not len(asked) or not len(m):
            return
        points, n, label, band = _sketches(t.column("point")), c["n"], c["label"], int(c["band"][0])
        counts = [] if nearest else t.column("counts").to_pylist()
        theirs = np.ascontiguousarray(points[m].T)  # a row for each register, so that comparing stays within the cache
        for q in asked.tolist():
            same = np.zeros(len(m), dtype=np.int16)
            for k in range(BUCKETS):
                same += theirs[k] == points[q, k]
            chance = collisions(n[q], n[m])
            j = (same / BUCKETS - chance) / (1 - chance)
            ok = (j >= least) & (label[m] != label[q]) & (100 * np.minimum(n[m], n[q]) >= percent * np.maximum(n[m], n[q]))
            if not ok.any():
                continue
            if nearest:
                best = int(np.where(ok, j, -1).argmax())
                yield c["id"][[q]], c["id"][m[[best]]], j[[best]]
                continue
            at = m[ok]
            if band > 0:
                at = at[(points[at] == points[q]).reshape(len(at), -1, ROWS).all(axis=2).argmax(axis=1) == band]
            at = bounded(q, at, n, counts) if len(at) else at
            if len(at):
                ids = c["id"][at]
                yield np.minimum(ids, c["id"][q]), np.maximum(ids, c["id"][q]), np.zeros(len(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None

        def finish() -> Iterator[pa.RecordBatch]:
            found = list(pairs_of(held)) if held else []
            held.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b", "j"])

        for batch in batches:
            if not batch.num_rows:
                continue
            token, part = batch.column("token").to_numpy(), batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if now != (token[lo], part[lo]):
                    yield from finish()
                    now = (token[lo], part[lo])
                held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
        yield from finish()

    ordered = rows.select("token", "part", *names, "point", *extra).repartition("token", "part").sortWithinPartitions("token", "part")
    found = map_arrow(ordered, run, "a long, b long, j double")
    if nearest:
        return found.groupBy("a").agg(F.max_by("b", F.struct("j", "b")).alias("b"))
    return found.select("a", "b").distinct()  # a pair of two asked sets is found from both


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, label after the links have joined whole components."""
    end = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    edges = links.join(end("a"), "a").join(end("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()
    over = components(edges).select(F.col("node").alias("label"), F.col("label").alias("over"))
    return saved(labels.join(over, "label", "left").select("node", F.coalesce("over", "label").alias("label")))


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(profiles of every row; d0, d1, label of every set that shares a band with another)."""
    rows = saved(profiles(docs, words, percent))
    extra = repeated_rows(rows)
    own = rows.filter("point is not null").join(F.broadcast(extra) if extra.count() <= MOST_SENT else extra, "row", "left_anti").select(F.col("row").alias("id"), "place", "n", "d0", "d1", "point", "counts")
    blocks = blocks_of(banded(own))
    nodes = saved(own.join(blocks.select("id").distinct(), "id", "left_semi"))
    sets = nodes.select("id", "n", "point", "counts")
    first = roots(verified(hub_pairs(blocks, sets, percent), docs, nodes, words, percent))
    labels = saved(nodes.select(F.col("id").alias("node")).join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    for turn in range(NEAREST + 1):
        unsettled = mixed(blocks, labels)
        if unsettled.isEmpty():
            break
        within = parted(unsettled.select("token", "band", "id", "size"), sets, chunk * parts)
        pairs = compared(mixed(within, labels), sets, percent, chunk, turn < NEAREST)
        links = saved(verified(pairs, docs, nodes, words, percent))
        if not links.isEmpty():
            labels = merged(labels, links)
    return rows, nodes.join(labels.withColumnRenamed("node", "id"), "id").select("d0", "d1", "label")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK, parts: int = PARTS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; the bands suit similarities of 80 hundredths or more."""
    if percent < PERCENT:
        raise ValueError(f"bands of {ROWS} registers would miss pairs below {PERCENT} hundredths")
    rows, labels = linked(docs, words, percent, chunk, parts)
    rows = rows.select("doc_id", "n", "d0", "d1")
    least: Column = F.min("doc_id")
    each = rows.filter("n > 0").groupBy("d0", "d1").agg(least.alias("own"), F.count("*").alias("c")).join(labels, ["d0", "d1"], "left")
    heads = each.filter("label is not null").groupBy("label").agg(F.min("own").alias("head"))
    found = each.filter("c > 1 or label is not null").join(heads, "label", "left").select("d0", "d1", F.coalesce("head", "own").alias("lead"))
    out = rows.join(found, ["d0", "d1"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("lead", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def query(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))
