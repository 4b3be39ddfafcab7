"""Phrases of two and three words in Arrow text columns: a table of counters for all, exact counts for some.

What is selected by counters is told exactly: a counter is the sum over all phrases that fall on
it, so no phrase occurs more often than its counter says. Tasks work on slices of a batch, so
their memory depends on the slice and on its longest text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracelake.shipping import ship

#: Counters of each length of phrase, and the parts that tasks send them in.
COUNTERS, PARTS = 1 << 20, 32
LENGTHS = (2, 3)
#: Bytes of text in one step, and distinct phrases that a task holds before it sends their counts.
SLICE_BYTES, HELD = 1 << 20, 100_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IN_WORD = np.isin(np.arange(256), [*range(48, 58), *range(97, 123)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets of the texts) of slices of about SLICE_BYTES; a longer text stands alone."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, lo = np.frombuffer(data, dtype=np.uint8), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, side="right")) - 1)
        if at[hi] > at[lo]:
            yield data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _words(data: np.ndarray, at: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the runs of a-z and 0-9 that are over ``longer`` bytes; runs end with their text."""
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - start > longer
    start, end = start[long], end[long]
    return start, end, np.searchsorted(at, start, side="right")


def _places(data: np.ndarray, at: np.ndarray, longer: int, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(start, end) of the words, and for each length the first words of its phrases and their counters; phrases of ``stop`` words alone are left out."""
    start, end, text = _words(data, at, longer)
    up, down = _powers(len(data), _BASE), _powers(len(data), _INVERSE)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up, dtype=np.uint64, out=sums[1:])
    word = _mix((sums[end] - sums[start]) * down[start])
    # a word of up to eight bytes as one number, which tells it exactly
    code = np.zeros(len(start), dtype=np.uint64)
    for i in range(8):
        code |= np.where(end - start > i, data[np.minimum(start + i, len(data) - 1)], 0).astype(np.uint64) << _U(8 * i)
    none = (end - start <= 8) & np.isin(code, stop)
    found = []
    for k, n in enumerate(LENGTHS):
        m = max(len(start) - n + 1, 0)
        whole = text[:m] == text[n - 1 :][:m]
        whole &= ~np.logical_and.reduce([none[i : i + m] for i in range(n)])
        which = np.flatnonzero(whole)
        h = word[which]
        for i in range(1, n):
            h = _mix(h * _U(_BASE) + word[which + i])
        found.append((which, (h & _U(COUNTERS - 1)).astype(np.int64) + k * COUNTERS))
    return start, end, found


def _codes(stop: tuple[str, ...]) -> np.ndarray:
    if any(len(w.encode()) > 8 for w in stop):
        raise ValueError("stop words have up to eight bytes")
    return np.array([int.from_bytes(w.encode(), "little") for w in stop], dtype=np.uint64)


def counters(texts: DataFrame, longer: int, stop: tuple[str, ...]) -> np.ndarray:
    """How many phrases of the lower-cased column ``text`` fall on each counter: a row a length.

    Tasks send their tables in parts, which are summed in a stream; one table, whose size doesn't
    depend on the texts, comes to the driver.
    """
    ship(texts.sparkSession)
    codes, each = _codes(stop), len(LENGTHS) * COUNTERS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LENGTHS) * COUNTERS, dtype=np.int64)
        for b in batches:
            for data, at in _slices(b.column("text")):
                for _, places in _places(data, at, longer, codes)[2]:
                    np.add.at(total, places, 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in total.reshape(PARTS, each)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])
        for b in batches:
            for part, counts in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
                if part != now and now is not None:
                    yield row()
                counts = np.frombuffer(counts.as_buffer(), dtype=np.int64)
                now, total = part, total + counts if part == now else counts
        if now is not None:
            yield row()

    schema = "part int, counts binary"
    parts = texts.select("text").mapInArrow(count, schema).repartition("part").sortWithinPartitions("part").mapInArrow(add, schema).toArrow()
    out = np.zeros((PARTS, each), dtype=np.int64)
    for part, counts in zip(parts["part"].to_pylist(), parts["counts"].to_pylist(), strict=True):
        out[part] = np.frombuffer(counts, dtype=np.int64)
    return out.reshape(len(LENGTHS), COUNTERS)


def phrases_on(texts: DataFrame, longer: int, stop: tuple[str, ...], chosen: np.ndarray) -> DataFrame:
    """phrase, words, n: exact counts, in parts that add up, of the phrases whose counters are ``chosen`` (true or false for each)."""
    ship(texts.sparkSession)
    codes, flags = _codes(stop), np.packbits(chosen.reshape(-1)).tobytes()

    def rows(held: Counter) -> pa.RecordBatch:
        phrases, lengths = [p.decode() for p, _ in held], [n for _, n in held]
        return pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(lengths, pa.int32()), pa.array(held.values(), pa.int64())], ["phrase", "words", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held = np.unpackbits(np.frombuffer(flags, dtype=np.uint8)).astype(bool), Counter()
        for b in batches:
            for data, at in _slices(b.column("text")):
                start, end, found = _places(data, at, longer, codes)
                raw = data.tobytes()
                for n, (which, places) in zip(LENGTHS, found, strict=True):
                    firsts = which[wanted[places]]
                    spans = np.stack([x[firsts + i] for i in range(n) for x in (start, end)], axis=1).tolist() if len(firsts) else []
                    held.update((b" ".join(raw[s[i] : s[i + 1]] for i in range(0, 2 * n, 2)), n) for s in spans)
                    if len(held) > HELD:
                        yield rows(held)
                        held = Counter()
        if held:
            yield rows(held)

    return texts.select("text").mapInArrow(count, "phrase string, words int, n long")
