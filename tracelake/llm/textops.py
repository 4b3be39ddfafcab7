"""Vectorised helpers over Arrow string columns: byte views, words, rolling hashes.

Everything here works on bounded slices of one Arrow batch, so that a task's memory
depends on the slice size and on its longest text, never on its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step looks at.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64) | _U(1)
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in [0, n)."""
    if len(_POWERS["up"]) < n:
        m = 1 << int(n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(m, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h ^= h >> _U(27)
    h *= _U(0x81DADEF4BC2DD44D)
    h ^= h >> _U(33)
    return h


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column with nulls as empty strings and 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def byte_view(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) without copying."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.LargeStringArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text stands alone."""
    _, at = byte_view(texts)
    n, lo = len(texts), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums S, so that data[i:j] hashes to (S[j]-S[i]) * base**-i."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOL[data] * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def window_hash(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[starts + length] - sums[starts]) * down[starts])


#: Letters lower-cased, digits and all beyond ASCII kept, the rest a space.
PLAIN = np.where(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), _LOWER, 0x20).astype(np.uint8)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, A-Z lower-cased.

    ``hash`` has one value a word, ``doc`` the row (from 0) it belongs to, ``first`` the
    number of the first word of each row (with one more entry at the end).
    """

    def __init__(self, texts: pa.LargeStringArray, table: np.ndarray = _LOWER):
        """table: what each byte becomes before the text is cut into words."""
        raw, at = byte_view(texts)
        n = len(texts)
        data = np.full(len(raw) + n, 0x20, dtype=np.uint8)  # a space between rows
        place = np.ones(len(data), dtype=bool)
        place[at[1:] + np.arange(n)] = False
        data[place] = table[raw]
        self.row_start = at[:-1] + np.arange(n)
        space = _IS_SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.data, self.start, self.end = data, edge[0::2], edge[1::2]
        sums = prefix_hash(data)
        _, down = powers(len(data) + 1)
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, np.append(self.row_start, len(data) + 1))
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of each run of ``size`` words within a row; rows with fewer words give one run of all."""
        h, n = self.hash, len(self.hash)
        _, down = powers(n + 1)
        up, _ = powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * up[:n], dtype=np.uint64, out=sums[1:])
        counts = np.diff(self.first)
        full = np.maximum(counts - size + 1, 0)
        rows = np.repeat(np.arange(len(counts)), full)
        starts = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full) + self.first[:-1][rows]
        out = mix((sums[starts + size] - sums[starts]) * down[starts] if len(starts) else np.zeros(0, np.uint64))
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            s, e = self.first[short], self.first[short + 1]
            whole = mix(((sums[e] - sums[s]) * down[s]) ^ _U(0xA5A5A5A5A5A5A5A5))
            out, rows = np.concatenate((out, whole)), np.concatenate((rows, short))
            order = np.argsort(rows, kind="stable")
            out, rows = out[order], rows[order]
        return out, rows


def distinct_per_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, in row order with ascending values."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[new], rows[new]
    return values, rows


def ragged(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list column with the values of each of n rows."""
    at = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
