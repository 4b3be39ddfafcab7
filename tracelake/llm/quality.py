"""Bradley-Terry quality classifier.

Each labelled preference pair says that a document of label 1 beats one of label 0. Document
scores are linear in surface features; they are learned by logistic loss on the pair's
feature difference, and the cut is the quantile of the learning rows' scores that lets the
learned share of documents through.

Learning uses at most ``MOST_LABELLED`` rows of each label, taken by the hash of their id;
their features, a few numbers a row, are fitted by Newton steps on the driver. Every document
is scored over its whole text.

Defined cases: null and empty texts have all features 0 and get a score like any other;
labels that are null, and labels of documents that are missing, aren't learned from; without
labels of both kinds every score is 0.5; repeated rows stay repeated; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import fold, map_arrow, read
from tracelake.llm.textops import Words, byte_view, slices, texts_of

#: Bound of the labelled sample, for each label.
MOST_LABELLED = 20_000
#: Opponents that each learned document meets.
ROUNDS = 4

FEATURES = ("symbol_share", "upper_share", "digit_share", "repeat_share", "distinct_share", "bar_share", "word_length", "end_share", "short")

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[ord(c) for c in "%$&*#!@^~=+<>{}[]\\_"]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[ord("|")] = 4


def features_of(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    texts, out = texts_of(column), []
    for lo, hi in slices(texts):
        part = texts.slice(lo, hi - lo)
        raw, at = byte_view(part)
        n = hi - lo
        size = np.maximum(np.diff(at), 1).astype(float)
        kinds = _KIND[raw]

        def share(mask, at=at, size=size):
            sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
            return (sums[at[1:]] - sums[at[:-1]]) / size

        words = Words(part)
        count = np.diff(words.first)
        many = np.maximum(count, 1)
        again = np.zeros(len(words.hash), dtype=np.int64)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        repeat = np.bincount(words.doc, weights=again, minlength=n)
        order = np.lexsort((words.hash, words.doc))
        h, d = words.hash[order], words.doc[order]
        new = np.ones(len(h), dtype=np.int64)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        distinct = np.bincount(d, weights=new, minlength=n)
        stops = np.isin(words.data[np.maximum(words.end - 1, 0)], np.frombuffer(b".!?", dtype=np.uint8)) if len(words.end) else np.zeros(0)
        ends = np.bincount(words.doc, weights=stops, minlength=n)
        length = np.bincount(words.doc, weights=words.end - words.start, minlength=n) / many
        rows = np.stack(
            [
                np.sqrt(share(kinds == 1)), share(kinds == 2), share(kinds == 3), repeat / many,
                # distinct words fall as the square root of the length in any prose, so it is measured against that
                np.minimum(distinct / np.sqrt(many), 20) / 20, share(kinds == 4) * 10, np.minimum(length, 40) / 40, np.minimum(ends / many, 0.5), 1 / (1 + count),
            ],
            axis=1,
        )
        rows[count == 0] = 0
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and the feature array of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features_of(b.column("text"))
            at = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], ["doc_id", "x"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, x array<double>")


def bradley_terry(diff: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-w.d)) over the rows d, with a small quadratic penalty, by Newton steps."""
    w = np.zeros(diff.shape[1])
    loss = lambda w: np.logaddexp(0, -(diff @ w)).mean() + penalty / 2 * (w @ w)
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))  # how likely the loser is to win
        gradient = penalty * w - diff.T @ p / len(diff)
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + penalty * np.eye(len(w))
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        was, now = now, loss(w)
        if was - now < 1e-12:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """(weights, cut, scale) from the labelled rows of ``docs``; a score is 1/(1+exp(-(w.x-cut)*scale))."""
    one = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    spread = F.xxhash64("doc_id", F.lit("sample"))
    chosen = None
    for label in (0, 1):
        part = one.filter(F.col("quality") == label).orderBy(spread, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.join(F.broadcast(chosen), "doc_id")  # 2 * most ids at the most
    rows = with_features(sample).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id").toArrow()
    x = np.asarray(rows["x"].combine_chunks().flatten(), dtype=float).reshape(rows.num_rows, len(FEATURES))
    y = rows["quality"].to_numpy()
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(len(FEATURES)), 0.0, 1.0
    # every document meets `rounds` opponents of the other label
    draw = np.random.default_rng(7)
    longer = max(len(good), len(bad)) * rounds
    won, lost = (np.resize(draw.permutation(np.resize(a, longer)), longer) for a in (good, bad))
    scale = x.std(axis=0) + 1e-9
    w = bradley_terry((x[won] - x[lost]) / scale) / scale
    # the cut is the quantile of scores below which the share of label 0 lies
    s = np.sort(x @ w)
    k = len(bad)
    return w, float((s[k - 1] + s[k]) / 2), 1.0


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """doc_id and score of every row."""
    w, cut, scale = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.clip((features_of(b.column("text")) @ w - cut) * scale, -500, 500)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, learn_from=None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; the labels of held-out rows aren't learned from."""
    held_out = fold(F.col("doc_id"), 3) == 1
    model = learn(docs if learn_from is None else learn_from, labels.filter(~held_out))
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    model = learn(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    w, cut, scale = model
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = (features_of(b.column("text")) @ w - cut) * scale
            yield b.filter(pa.array(z >= 0)).select(names)

    return map_arrow(docs, run, docs.schema)


def query(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
