"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Only the histogram of piece lengths (at most ``capacity`` rows) comes to the driver. There
the reduction fixes sets of lengths that provably dominate every other set with the same
largest piece, with the multiplicity the counts allow; best-fit decreasing packs what is
left. The plan is a table of (length, rank range) -> (sequence, offset); each piece finds its
place by its rank among the pieces of its length: tasks number the pieces of each length as they
cut them, and the counts of the tasks before them are added, so no rows are sorted.

Defined cases: null and empty texts are the closing id alone; repeated rows are packed once a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import map_arrow, read, saved

CAPACITY = 2048
CLOSING_ID = 0
TOKENIZER = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary as ranks; texts that hold a special token's string get its id, as in the JSON form."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str, path: str = "") -> np.ndarray:
    """The text's ids and the closing id."""
    e = encoder(path)
    ids = e.encode_to_numpy(text, allowed_special="all") if any(s in text for s in SPECIAL) else e.encode_ordinary(text)
    out = np.empty(len(ids) + 1, dtype="<u4")
    out[:-1] = ids
    out[-1] = CLOSING_ID
    return out


def cuts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces: full ones from the end, so that the first may be shorter."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = "") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids of every piece, and its number k among its task's pieces of its length."""
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("k", pa.int64()), ("ids", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            tokens: list[np.ndarray] = [np.zeros(0, dtype="<u4")]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = token_ids(text.as_py() or "", path)
                tokens.append(ids)
                starts = cuts(len(ids), capacity)
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    for column, v in zip(out, (doc_id, k, a, z - a, zlib.crc32(ids[a:z]), int(seen[z - a])), strict=True):
                        column.append(v)
                    seen[z - a] += 1
            ends = np.concatenate(([0], np.cumsum(out[3]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens).view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(out, schema, strict=False)), ids], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, k long, ids array<int>")


class _Pool:
    """Counts of the lengths that are still free."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def free(self, size: int, but: tuple[int, ...]) -> int:
        return self.n.get(size, 0) - but.count(size)

    def largest(self, room: int, but: tuple[int, ...]) -> int:
        """The largest free length up to ``room``, 0 if there is none."""
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0 and self.free(self.sizes[i], but) <= 0:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, k: int, but: tuple[int, ...]) -> list[int]:
        """The k smallest free lengths, with repeats."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), max(0, self.free(s, but)))
            if len(out) >= k:
                break
        return out


def dominating(pool: _Pool, i: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``i`` that dominates all feasible sets with ``i``, if one is proven."""
    room = capacity - i
    low = pool.smallest(3, (i,))
    if not low or low[0] > room:
        return (i,)  # nothing fits beside it
    j = pool.largest(room, (i,))
    if i + j == capacity:
        return (i, j)  # what any other set puts beside i fits in j's place
    if len(low) < 2 or low[0] + low[1] > room:
        return (i, j)  # only pairs are feasible, and j is the largest partner
    if len(low) < 3 or sum(low) > room:
        k = pool.largest(room - j, (i, j))
        # of any feasible pair beside i the larger is at most j; the smaller must be at most k
        b = pool.largest(room // 2, (i,))
        while b > k and not _has_partner(pool, b, room - b, i):
            b = pool.largest(b - 1, (i,))
        if k and b <= k:
            return (i, j, k)
    return None


def _has_partner(pool: _Pool, b: int, room: int, i: int) -> bool:
    """Whether another free length of at least b fits into the room."""
    return pool.largest(room, (i, b)) >= b


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed sets with multiplicities, remaining counts)."""
    pool, fixed = _Pool(counts), []
    for i in sorted(counts, reverse=True):
        while pool.n.get(i, 0) and (best := dominating(pool, i, capacity)):
            times = min(pool.n[s] // best.count(s) for s in set(best))
            if len(best) == 3:
                times = 1  # its proof is about the lengths free just now
            for s in best:
                pool.take(s, times)
            fixed.append((best, times))
    return fixed, dict(pool.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, a whole count at a time: (set, multiplicity)."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, held: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((held, n))

    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                held, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, held, n = capacity, (), c  # as many new sequences as may be needed
            each = room // s
            filled = min(n, c // each)
            if filled:
                put(room - each * s, held + (s,) * each, filled)
                c -= filled * each
            elif c:
                put(room - c * s, held + (s,) * c, 1)
                c, filled = 0, 1
            if held and n > filled:
                put(room, held, n - filled)
    return [x for held in open_.values() for x in held]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(sets: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) in the order of ranks."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for held, n in sets:
        offset = 0
        for s in held:
            out.setdefault(s, []).append((ranks.get(s, 0), sequence, offset))
            ranks[s] = ranks.get(s, 0) + n
            offset += s
        sequence += n
    return {s: np.array(v, dtype=np.int64) for s, v in out.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = "", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and its ids if they are asked for."""
    spark = docs.sparkSession
    cut = pieces(docs, capacity, path).withColumn("part", F.spark_partition_id())
    rows = saved(cut if ids else cut.drop("ids"))
    per = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = rows.join(starts, ["length", "part"]).withColumn("rank", F.col("k") + F.col("before")).drop("before", "part", "k")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                t = table.value[int(s)]
                k = np.searchsorted(t[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = t[k, 1] + rank[at] - t[k, 0], t[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = f"doc_id long, piece int, start long, length long, ids_crc32 long, {'ids array<int>, ' if ids else ''}sequence_id long, offset long"
    return map_arrow(ranked, run, kinds)


def sequences(docs: DataFrame, capacity: int = CAPACITY, path: str = "") -> DataFrame:
    """sequence_id and ids of every packed sequence, of ``capacity`` ids at most."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pack(docs, capacity, path, ids=True).groupBy("sequence_id").agg(F.flatten(F.transform(held, lambda p: p["ids"])).alias("ids"))


def query(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))
