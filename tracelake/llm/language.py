"""Language identification by language-bitmask n-gram filters.

The n-grams of the learning texts are counted per language; those that make up at least
``MIN_SHARE`` of a language's n-grams enter its set, so a language has 1/MIN_SHARE members at
the most. All sets go into one bit-sliced Bloom filter: each position holds a mask with one
bit a language, and the AND over an n-gram's positions is the set of languages that contain
it. A text's n-grams are counted per language bit, each count is corrected for the filter's
false positives, and the language with the highest corrected count wins.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a text whose
n-grams no language contains goes to the first language with score 0; ties go to the first
language in alphabetical order; without any learning row all texts are ``und``; repeated rows
stay repeated; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import fold, map_arrow, read
from tracelake.llm.textops import byte_view, mix, prefix_hash, powers, slices, texts_of

#: n-gram lengths in bytes of UTF-8 text.
SIZES = (3, 4, 5)
MIN_SHARE = 4e-5
#: Positions of the filter (a power of two) and positions an n-gram has.
BITS, HASHES = 1 << 20, 3
MOST_LANGUAGES = 64

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # all but letters is a space


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every n-gram of folded text within a row."""
    sums = prefix_hash(data)
    _, down = powers(len(sums))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    hashes, rows = [], []
    letter = (data != 32).astype(np.int8)
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        inside = row[:m] == row[n - 1 :]
        inside &= letter[:m] | letter[n - 1 :] > 0
        i = np.flatnonzero(inside)
        hashes.append(mix(((sums[i + n] - sums[i]) * down[i]) ^ _U(n)))
        rows.append(row[i])
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def _positions(h: np.ndarray) -> list[np.ndarray]:
    h = mix(h)
    step = (h >> _U(32)) | _U(1)
    return [((h + _U(i) * step) & _U(BITS - 1)).astype(np.int64) for i in range(HASHES)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram (64-bit hash) and count over all rows; each task sums up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = texts_of(b.column("text")), pc.dictionary_encode(b.column("lang"))
            code, names = langs.indices.to_numpy(), langs.dictionary
            kept: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in slices(texts):
                raw, at = byte_view(texts.slice(lo, hi - lo))
                h, row = _grams(_FOLD[raw], at)
                # the language's number replaces the lowest bits of the hash while counting
                kept.append(np.unique((h & ~_U(MOST_LANGUAGES - 1)) | code[lo + row].astype(_U), return_counts=True))
            if not kept:
                continue
            keys, counts = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
            keys, back = np.unique(keys, return_inverse=True)
            counts = np.bincount(back, weights=counts.astype(float)).astype(np.int64)
            lang = names.take(pa.array((keys & _U(MOST_LANGUAGES - 1)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([lang, pa.array((keys & ~_U(MOST_LANGUAGES - 1)).view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    rows = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    return map_arrow(rows, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, min_share: float = MIN_SHARE) -> tuple[list[str], np.ndarray]:
    """(languages, masks): the bit-sliced filter, 8 * BITS bytes whatever the corpus."""
    from tracelake.llm.common import saved

    counts = saved(gram_counts(docs))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    members = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= F.col("total") * min_share).select("lang", "gram")
    # 1/min_share members a language and MOST_LANGUAGES languages bound what comes to the driver
    names = sorted(r["lang"] for r in totals.select("lang").collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    masks = np.zeros(BITS, dtype=np.uint64)
    got = members.toArrow()
    code = {name: i for i, name in enumerate(names)}
    bit = _U(1) << np.array([code[x] for x in got["lang"].to_pylist()], dtype=np.uint64)
    for at in _positions(got["gram"].to_numpy().view(np.uint64)):
        np.bitwise_or.at(masks, at, bit)
    return names, masks


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of every row over its whole text."""
    names, masks = model
    k = len(names)
    shared = docs.sparkSession.sparkContext.broadcast(masks)
    filled = np.array([np.count_nonzero(masks & (_U(1) << _U(i))) / BITS for i in range(k)])
    wrong = filled**HASHES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = shared.value
        for b in batches:
            texts = texts_of(b.column("text"))
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            best, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            for lo, hi in slices(texts) if k else ():
                raw, at = byte_view(texts.slice(lo, hi - lo))
                h, row = _grams(_FOLD[raw], at)
                h &= ~_U(MOST_LANGUAGES - 1)
                first, *rest = _positions(h)
                hit = masks[first]
                for p in rest:
                    hit &= masks[p]
                n = np.bincount(row, minlength=hi - lo).astype(float)
                counts = np.stack([np.bincount(row, weights=((hit >> _U(i)) & _U(1)).astype(float), minlength=hi - lo) for i in range(k)], axis=1)
                true = np.maximum(counts - n[:, None] * wrong, 0) / (1 - np.minimum(wrong, 0.999))
                best[lo:hi] = true.argmax(axis=1)
                score[lo:hi] = np.where(n > 0, true.max(axis=1) / np.maximum(n, 1), 0)
            lang = pa.array(names, pa.string()).take(pa.array(best)) if k else pa.nulls(len(texts), pa.string())
            lang = pc.if_else(pa.array(letters & (k > 0)), lang, "und")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lang, pa.array(np.clip(np.where(letters, score, 0), 0, 1))], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; held-out rows aren't learned from."""
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = learn(docs.filter((fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull()))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir):
    return identify(read(spark, sf_dir, "documents"))
