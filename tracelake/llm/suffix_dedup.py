"""Removal of repeated byte strings by sharded suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller
id goes. A string of LENGTH bytes is routed by its minimizer (of its ``MINIMIZER``-byte
substrings the one with the smallest hash, the frequent ones by a fixed-size sketch of the
corpus last), so equal strings meet in one shard whatever document they stand in; neighbouring
strings with the same minimizer travel as one piece of text. Equal pieces of one task meet
before the shuffle. A shard leaves out pieces none of whose strings'
hashes occurs twice in it, then builds the suffix array of the others by induced sorting:
suffixes are classified, leftmost-smaller substrings sorted and named, the suffix order is
induced from them linearly, bucket by bucket, and common prefixes are computed in text order
(permuted) as far as LENGTH. Runs of suffixes that share LENGTH bytes give the removed
strings; document-wise unions of those give the removed bytes.

Defined cases: null and empty texts have nothing to remove and the hash of the empty string;
texts shorter than LENGTH are untouched; rows with a null id neither remove nor lose bytes;
rows that repeat an id and text get the same result each, and rows that share only the id
don't remove from each other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_arrow, partitions, read, saved
from tracelake.llm.sketches import counted
from tracelake.llm.textops import byte_view, mix, powers, prefix_hash, slices, texts_of, window_hash

LENGTH = 50
MINIMIZER = 8
#: Counters of the sketch that tells frequent minimizers (a power of two).
COUNTERS = 1 << 20
#: Times the mean count from which a minimizer gives way to rarer ones.
FREQUENT = 16
#: Bytes of pieces that a shard gets on average; the number of shards follows the table's bytes.
SHARD_BYTES = 3 << 20
#: Compression of what is shuffled.
LEVEL = 7
#: Bytes of text that pieces are cut from at a time, and that meet before they are sent.
SLICE, STEP = 1 << 19, 3 << 20

_U = np.uint64


# pieces ---------------------------------------------------------------------------------


def minimizer_hashes(data: np.ndarray, k: int = MINIMIZER) -> np.ndarray:
    return window_hash(prefix_hash(data), np.arange(max(0, len(data) - k + 1)), k)


def rarity(docs: DataFrame, k: int = MINIMIZER) -> np.ndarray:
    """For each counter of the sketch 0, or where it is over FREQUENT times the mean, the binary logarithm of its count."""
    counts = counted(docs, lambda texts: minimizer_hashes(byte_view(texts)[0], k), COUNTERS)
    return np.where(counts > FREQUENT * counts.mean(), np.log2(counts + 1.0), 0).astype(np.uint8)


def minimizer_runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH, k: int = MINIMIZER, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, count, minimizer hash) of runs of consecutive strings that share a minimizer's place.

    ``at`` holds the rows' offsets in ``data``; a run covers data[start : start + count - 1 + length].
    """
    w = length - k + 1
    n = len(data) - length + 1
    size = np.diff(at)
    if n <= 0 or not (size >= length).any():
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64)
    h = minimizer_hashes(data, k)
    # the low bits hold the place, so that the leftmost of equal hashes wins
    bits = _U(max(1, int(len(h)).bit_length()))
    key = ((h << _U(6)) >> (bits + _U(6)) << bits) | np.arange(len(h), dtype=np.uint64)
    if classes is not None:  # at most 63
        key |= classes[(h & _U(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << _U(58)
    # sliding minimum over w places: minima of whole blocks from the left and from the right
    m = -(-len(key) // w) * w
    padded = np.full(m, ~_U(0))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    place = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    inside = row[:n] == row[length - 1 :]
    new = np.ones(n, dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (row[1:n] != row[: n - 1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    ok = inside[first]
    first, count = first[ok], count[ok]
    return row[first], first, count, h[place[first]]


def take(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    ends = np.cumsum(size)
    at = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    if len(at):
        at[0] = start[0]
        at[ends[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
        np.cumsum(at, out=at)
    return data[at]


PIECES = pa.schema([("shard", pa.int32()), ("doc_id", pa.binary()), ("version", pa.binary()), ("start", pa.binary()), ("count", pa.binary()), ("whole", pa.binary()), ("text", pa.binary())])
#: Types inside the packed columns; ids travel as steps from one piece to the next.
KINDS = {"doc_id": np.int64, "version": np.int64, "start": np.int64, "count": np.int64, "whole": np.bool_, "text": np.uint8}


def _packed(a: np.ndarray) -> bytes:
    """Compressed numbers: the narrowest type that holds them, its bytes plane by plane."""
    if a.dtype != np.uint8:
        a = a.astype(np.int64)
        lo, hi = (int(a.min()), int(a.max())) if len(a) else (0, 0)
        a = a.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= lo and hi <= np.iinfo(k).max))
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return bytes([a.itemsize]) + zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(b: bytes, kind) -> np.ndarray:
    size = b[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), dtype=np.uint8).reshape(size, -1)
    if kind is np.uint8:
        return planes[0]
    return np.ascontiguousarray(planes.T).view({1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[size]).ravel().astype(kind)


def cut_pieces(docs: DataFrame, shards: int, length: int = LENGTH, classes: np.ndarray | None = None) -> DataFrame:
    """Rows of packed pieces, a row for each shard and some MB of text.

    A piece whose bytes another document of the same step holds, with a smaller id, carries
    no text: all its strings go, and it only reports that.
    """

    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        held: list[tuple] = []
        bytes_held = 0
        for b in batches:
            texts = texts_of(b.column("text"))
            ids, version = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("version").to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts, SLICE):
                data, at = byte_view(texts.slice(lo, hi - lo))
                row, start, count, h = minimizer_runs(data, at, length, classes=classes)
                held.append((data, ids[lo + row], version[lo + row], start, start - at[row], count, h))
                bytes_held += len(data)
                if bytes_held >= STEP:
                    yield from _send(held, shards, length)
                    held, bytes_held = [], 0
        yield from _send(held, shards, length)

    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "version", "text")
    kinds = "shard int, doc_id binary, version binary, start binary, count binary, whole binary, text binary"
    return map_arrow(rows, run, kinds)


def _send(held: list[tuple], shards: int, length: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    base = np.cumsum([0, *(len(x[0]) for x in held)])
    data = np.concatenate([x[0] for x in held])
    ids, version, place, count, h = (np.concatenate([x[i] for x in held]) for i in (1, 2, 4, 5, 6))
    start = np.concatenate([x[3] + o for x, o in zip(held, base, strict=False)])
    if not len(ids):
        return
    size = count + length - 1
    whole = repeats_of(data, start, size, ids)
    shard = (mix(h) % _U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    columns: list[list] = [[] for _ in PIECES]
    for s in range(shards):
        i = order[edges[s] : edges[s + 1]]
        if not len(i):
            continue
        own = i[~whole[i]]
        values = (s, _packed(np.diff(ids[i], prepend=0)), _packed(version[i]), _packed(place[i]), _packed(count[i]), _packed(whole[i]), _packed(take(data, start[own], size[own])))
        for column, v in zip(columns, values, strict=True):
            column.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)


def repeats_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ranges have the bytes of another range with a smaller id; hashes propose, bytes are compared."""
    out = np.zeros(len(start), dtype=bool)
    if not len(start):
        return out
    sums = prefix_hash(data)
    _, down = powers(len(sums))
    content = ((sums[start + size] - sums[start]) * down[start]) ^ (size.astype(np.uint64) << _U(48))
    order = np.lexsort((ids, content))
    c, d = content[order], ids[order]
    head = np.ones(len(c), dtype=bool)
    head[1:] = c[1:] != c[:-1]
    leader = np.flatnonzero(head)[np.cumsum(head) - 1]
    same = np.flatnonzero(d > d[leader])
    a, b = order[same], order[leader[same]]
    equal = np.flatnonzero(size[a] == size[b])
    if len(equal):
        x, y = take(data, start[a[equal]], size[a[equal]]), take(data, start[b[equal]], size[b[equal]])
        edges = np.cumsum(size[a[equal]]) - size[a[equal]]
        good = np.add.reduceat((x != y).astype(np.int64), edges) == 0
        out[a[equal[good]]] = True
    return out


# induced sorting ------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text``, exact as far as ``depth`` symbols; ties beyond that in any order.

    Suffixes are smaller-type or larger-type; leftmost-smaller substrings are sorted by one
    induction, named, and sorted recursively by the names (by doubling them, until depth is
    covered or all differ); a second induction gives the order of all suffixes.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    t = np.append(text.astype(np.uint16) + 1, 0).astype(np.uint16)  # the end is the smallest symbol; 16 bits sort by radix
    n += 1
    smaller = _types(t)
    left = np.zeros(n, dtype=bool)
    left[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(left)
    counts = np.bincount(t)
    order = _induce(t, smaller, counts, lms[np.argsort(t[lms], kind="stable")])
    order = order[left[order]]
    names, distinct = _names(t, left, lms, order)
    if distinct < len(lms):
        seq = names[lms]
        covered = 1
        while distinct < len(lms) and 2 * covered < depth:  # a leftmost-smaller substring steps at least two symbols
            after = np.zeros(len(seq), dtype=np.int64)
            after[:-covered or None] = seq[covered:] + 1 if covered < len(seq) else 0
            key = seq * (len(seq) + 2) + after
            u, seq = np.unique(key, return_inverse=True)
            distinct = len(u)
            covered *= 2
        order = lms[np.argsort(seq, kind="stable")]
    return _induce(t, smaller, counts, order)[1:]


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one."""
    n = len(t)
    step = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    step = np.append(step, 1)  # the last suffix counts as smaller
    nonzero = np.flatnonzero(step)
    return np.repeat(step[nonzero], np.diff(nonzero, prepend=-1))[:n] > 0


def _induce(t: np.ndarray, smaller: np.ndarray, counts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order.

    Buckets are walked by their first symbol; within one, what a wave of suffixes induces
    into the same bucket is the next wave.
    """
    n, symbols = len(t), len(counts)
    end = np.cumsum(counts)
    begin = end - counts
    sa = np.full(n, -1, dtype=np.int32)
    first = t[lms]
    at = np.searchsorted(first, np.arange(symbols + 1))
    used = np.flatnonzero(counts)
    head = begin.copy()

    def spread(found: np.ndarray, at: np.ndarray, step: int) -> None:
        """Puts suffixes into their buckets, in the order they come."""
        if not len(found):
            return
        c = t[found]
        o = np.argsort(c, kind="stable")
        c, found = c[o], found[o]
        lo = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        size = np.diff(np.append(lo, len(c)))
        sym = c[lo]
        rank = np.arange(len(c)) - np.repeat(lo, size)
        where = np.repeat(at[sym], size) + step * rank
        sa[where] = found
        at[sym] += step * size

    # larger-type suffixes, from the smallest bucket up
    for c in used:
        done = begin[c]
        while head[c] > done:  # waves of this bucket
            wave = sa[done : head[c]]
            done = head[c]
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            spread(before, head, 1)
        own = lms[at[c] : at[c + 1]]
        before = own[own > 0] - 1
        spread(before[~smaller[before]], head, 1)
    # smaller-type suffixes, from the largest bucket down
    tail = end - 1
    for c in used[::-1]:
        pos = end[c] - 1
        while pos > tail[c]:
            wave = sa[tail[c] + 1 : pos + 1][::-1]
            pos = tail[c]
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            spread(before, tail, -1)
        larger = sa[begin[c] : head[c]][::-1]
        before = larger[larger > 0] - 1
        spread(before[smaller[before]], tail, -1)
    if sa[0] < 0:
        sa[0] = n - 1
    return sa.astype(np.int64)


def _names(t: np.ndarray, left: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of leftmost-smaller substrings in the order of ``order``; equal substrings share one."""
    n = len(t)
    nxt = np.full(n, n - 1, dtype=np.int64)
    nxt[lms[:-1]] = lms[1:]
    size = nxt[order] - order + 1
    differ = np.ones(len(order), dtype=bool)
    a, b = order[:-1], order[1:]
    same = size[1:] == size[:-1]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        equal = t[np.minimum(a[live] + k, n - 1)] == t[np.minimum(b[live] + k, n - 1)]
        ended = k >= size[live] - 1
        done = equal & ended
        differ[live[done] + 1] = False
        live = live[equal & ~ended]
        k += 1
    names = np.zeros(n, dtype=np.int64)
    names[order] = np.cumsum(differ) - 1
    return names, int(differ.sum())


def repeated(text: np.ndarray, valid: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The starts of strings of ``length`` symbols that a smaller owner has as well.

    ``valid`` tells which starts stand for a string, ``owner`` the owner's rank at each.
    """
    sa = suffix_order(text, length)
    sa = sa[valid[sa]]
    if len(sa) < 2:
        return np.zeros(0, dtype=np.int64)
    # permuted common prefixes: each suffix against the one before it in order, taken in text order
    before = np.full(len(text), -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.flatnonzero(before >= 0)
    j = before[i]
    padded = np.concatenate((text, np.zeros(8, dtype=text.dtype)))
    words = _words(padded)
    for o in [*range(0, length - 8, 8), length - 8]:
        keep = words[i + o] == words[j + o]
        i, j = i[keep], j[keep]
    shares = np.zeros(len(text), dtype=bool)
    shares[i] = True
    start = ~shares[sa]
    run = np.cumsum(start) - 1
    least = np.minimum.reduceat(owner[sa], np.flatnonzero(start))
    return sa[owner[sa] > least[run]]


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number."""
    out = np.zeros(len(data) - 7, dtype=np.uint64)
    for k in range(8):
        out |= data[k : len(data) - 7 + k].astype(np.uint64) << _U(8 * k)
    return out


# shards ---------------------------------------------------------------------------------


def removed_in_shard(ids: np.ndarray, version: np.ndarray, place: np.ndarray, count: np.ndarray, text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(doc_id, version, start, end) of byte ranges to remove, from the pieces of one shard."""
    size = count + length - 1
    begin = np.cumsum(size) - size
    whole = repeats_of(text, begin, size, ids)
    parts = [(ids[whole], version[whole], place[whole], place[whole] + size[whole])]
    left = np.flatnonzero(~whole)
    # strings whose hash no other string of the shard has are left out with their pieces
    sums = prefix_hash(text)
    _, down = powers(len(sums))
    n = count[left]
    piece = np.repeat(np.arange(len(left)), n)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + begin[left][piece]
    h = (sums[at + length] - sums[at]) * down[at]
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    bits = max(10, int(len(twice) * 16).bit_length())
    spread, shift = _U(0x9E3779B97F4A7C15), _U(64 - bits)
    table = np.zeros(1 << bits, dtype=bool)
    table[(twice * spread >> shift).astype(np.int64)] = True
    near = np.flatnonzero(table[(h * spread >> shift).astype(np.int64)])  # other hashes fall on the same places
    near = near[twice[np.minimum(np.searchsorted(twice, h[near]), len(twice) - 1)] == h[near]] if len(twice) else near
    flagged = np.zeros(len(left), dtype=bool)
    flagged[piece[near]] = True
    keep = left[flagged]
    if len(keep):
        kept_text = take(text, begin[keep], size[keep])
        size, count = size[keep], count[keep]
        begin = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(keep)), size)
        offset = np.arange(len(kept_text)) - begin[piece]
        rank = np.unique(ids, return_inverse=True)[1][keep]
        found = np.sort(repeated(kept_text, offset < count[piece], rank[piece], length))
        p, o = piece[found], offset[found]
        new = np.ones(len(found), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (o[1:] > o[:-1] + length)
        first = np.flatnonzero(new)
        if len(first):
            last = np.append(first[1:], len(found)) - 1
            own = keep[p[first]]
            parts.append((ids[own], version[own], place[own] + o[first], place[own] + o[last] + length))
    return tuple(np.concatenate([x[i] for x in parts]) for i in range(4))


RANGES = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def removed_ranges(docs: DataFrame, length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """doc_id, version, start, end of byte ranges to remove; ranges of a document may overlap."""
    if shards is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # a string's run is (length - MINIMIZER + 2) / 2 strings on average, and its piece length - 1 bytes longer
        runs = (length - MINIMIZER + 2) / 2
        shards = max(1, int(total * (runs + length - 1) / runs / SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in PIECES.names}
                if r["shard"] != now:
                    yield from _shard(held, length)
                    now, held = r["shard"], []
                held.append(r)
        yield from _shard(held, length)

    pieces = cut_pieces(docs, shards, length, rarity(docs))
    return map_arrow(pieces.repartition(partitions(docs.sparkSession), "shard").sortWithinPartitions("shard"), run, "doc_id long, version long, start long, end long")


def _shard(held: list[dict], length: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    columns = {c: [_unpacked(r[c], k) for r in held] for c, k in KINDS.items()}
    held.clear()
    columns["doc_id"] = [np.cumsum(x) for x in columns["doc_id"]]
    ids, version, place, count, whole, text = (np.concatenate(columns.pop(c)) for c in KINDS)
    ready = (ids[whole], version[whole], place[whole], place[whole] + count[whole] + length - 1)
    own = ~whole
    found = removed_in_shard(ids[own], version[own], place[own], count[own], text, length) if own.any() else ready
    parts = (ready, found) if own.any() else (ready,)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in range(4)], schema=RANGES)


# documents ------------------------------------------------------------------------------


def versioned(docs: DataFrame) -> DataFrame:
    """doc_id, version, text; the version tells texts apart where an id stands for several, else it is 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = rows.select("doc_id", F.xxhash64("text").alias("h"))
    several = saved(hashed.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("doc_id"))
    if several.isEmpty():
        return rows.withColumn("version", F.lit(0).cast("long"))
    return rows.join(several.withColumn("s", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("s"), F.xxhash64("text")).otherwise(0).alias("version"), "text")


def compressed(rows: DataFrame) -> DataFrame:
    """doc_id, version and the compressed bytes of the text, null as empty: whole texts are shuffled once, small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = byte_view(texts_of(b.column("text")))
            z = zstandard.ZstdCompressor(level=3)
            packed = pa.array([z.compress(data[a:e].tobytes()) for a, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), packed], ["doc_id", "version", "packed"])

    return map_arrow(rows.select("doc_id", "version", "text"), run, "doc_id long, version long, packed binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that are kept) of every row."""
    rows = versioned(docs)
    # dealt before they are grouped: single ranges travel smaller than lists of one
    ranges = removed_ranges(rows, length, shards).repartition("doc_id", "version").groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = compressed(rows).join(ranges, ["doc_id", "version"], "left").select("doc_id", "packed", "ranges")
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed, given = b.column("packed"), b.column("ranges")
            z = zstandard.ZstdDecompressor()
            lists = given.offsets.to_numpy()
            null = given.is_null().to_numpy(zero_copy_only=False)
            starts, ends = (given.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            columns: list[list] = [[], [], [], []]
            for i in range(b.num_rows):
                text = np.frombuffer(z.decompress(packed[i].as_py()), dtype=np.uint8)
                kept, removed, spans = text, 0, 0
                if not null[i] and lists[i + 1] > lists[i]:
                    s, e = (x[lists[i] : lists[i + 1]].astype(np.int64) for x in (starts, ends))
                    change = np.zeros(len(text) + 1, dtype=np.int64)
                    np.add.at(change, s, 1)
                    np.add.at(change, e, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept, removed = text[~gone], int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                for column, v in zip(columns, (len(text), removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True))], schema=out)

    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"))
