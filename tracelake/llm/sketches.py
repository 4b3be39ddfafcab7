"""Counts of hashed items over a whole corpus, in a table of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tracelake.llm.common import map_arrow
from tracelake.llm.textops import slices, texts_of

PARTS = 64


def counted(docs: DataFrame, hashes: Callable[[pa.LargeStringArray], np.ndarray], counters: int) -> np.ndarray:
    """How often the hashes of all texts fall on each of ``counters`` places (a power of two).

    Tasks send their tables in parts, the parts are summed in a stream, and one table, whose
    size doesn't depend on the corpus, comes to the driver.
    """
    each = counters // PARTS
    mask = np.uint64(counters - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.uint32)
        for b in batches:
            texts = texts_of(b.column("text"))
            for lo, hi in slices(texts):
                total += np.bincount((hashes(texts.slice(lo, hi - lo)) & mask).astype(np.int64), minlength=counters).astype(np.uint32)
        packed = [zstandard.ZstdCompressor(level=1).compress(total[k * each : (k + 1) * each].tobytes()) for k in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, dtype=np.uint64)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])
        for b in batches:
            for i in range(b.num_rows):
                part = b.column("part")[i].as_py()
                counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column("counts")[i].as_py()), dtype=np.uint32)
                if part != now and now is not None:
                    yield row()
                total = total + counts if part == now else counts.astype(np.uint64)
                now = part
        if now is not None:
            yield row()

    rows = map_arrow(docs.select("text"), count, "part int, counts binary")
    sums = map_arrow(rows.repartition("part").sortWithinPartitions("part"), add, "part int, counts binary").toArrow()
    out = np.zeros(counters, dtype=np.uint64)
    for part, counts in zip(sums["part"].to_pylist(), sums["counts"].to_pylist(), strict=True):
        out[part * each : (part + 1) * each] = np.frombuffer(counts, dtype=np.uint64)
    return out
