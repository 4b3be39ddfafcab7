"""Spelling variants of a corpus's words, joined by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other.
One word contributes two disjoint chunks, its halves; the other contributes positional grams.
One edit touches one half at most, so the other half stands in the near word as well: the first
half at the same place, the second half shifted by the difference of the lengths, which is one
at most. Words meet by an equi-join on (length of the chunked word, half, gram), and the pairs
are verified. A pair that both halves find counts at the first half only, so no pair is made
distinct afterwards. Halves are the longest two disjoint chunks a word has, so a gram brings
few words together; Spark splits the partition of a half that very many words share.

A word's form is its most frequent near word where that is frequent enough. Frequencies grow
along forms, so forms are a forest, and roots are found by pointer jumping.

Words are counted in each task before they are shuffled, so a word that stands in every
document sends one row a task.

Defined cases: a null or empty text has no words; repeated rows count each time; a row without
an id hashes as if its id were empty text; words of equal frequency are ordered by code points;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_arrow, read, saved
from tracelake.llm.components import roots

#: Least length and least number of occurrences of a word, and how many times as frequent its form is.
LENGTH, LEAST, TIMES = 6, 5, 5
#: One of so many (document, run) loses a code point in the query.
DAMAGED = 199
#: Words that a task holds before it sends them.
HELD = 500_000
#: Characters of a text whose runs aren't listed at once.
LONG = 1 << 23

_RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: bytes) -> Counter[str]:
    """Runs of letters, A-Z lower-cased, with their numbers."""
    low = text.lower().decode()  # of bytes, only A-Z are lower-cased
    return Counter(_RUN.findall(low) if len(low) < LONG else (m.group() for m in _RUN.finditer(low)))


def damaged(doc_id: int | None, word: str, every: int) -> str:
    """The word as it stands in this document: where ``every`` divides the hash of both, without one code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, every: int | None = None, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """word, n of the words that are long and frequent enough; with ``every``, of a corpus damaged by this rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").cast(pa.large_binary())
            for i in range(b.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                doc_id = ids[i].as_py()
                for w, c in runs(text).items():
                    if len(w) < length:  # it can only get shorter
                        continue
                    if every:
                        w = damaged(doc_id, w, every)
                        if len(w) < length:
                            continue
                    total[w] = total.get(w, 0) + c
                if len(total) >= HELD:
                    yield rows()
        if total:
            yield rows()

    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every ordered pair of near words, from (word, n), words of three code points or more."""
    size = F.char_length("word")
    half = lambda n: F.floor(n / 2).cast("int")
    parts = lambda *xs: F.explode(F.array(*[F.struct(n.alias("length"), F.lit(k).alias("half"), g.alias("gram")) for n, k, g in xs])).alias("_c")
    w, q = F.col("word"), half(size)
    chunks = words.select(w.alias("a"), F.col("n").alias("n_a"), parts((size, 0, F.substr(w, F.lit(1), q)), (size, 1, F.substr(w, q + 1))))
    grams = []
    for shift in (-1, 0, 1):  # the gram's place less the chunk's: this word's length less the chunked word's
        n = size - shift
        grams += [(n, 0, F.substr(w, F.lit(1), half(n))), (n, 1, F.substr(w, half(n) + 1 + shift, n - half(n)))]
    grams = words.select(w.alias("b"), F.col("n").alias("n_b"), parts(*grams))
    chunks, grams = (x.select("*", "_c.*").drop("_c") for x in (chunks, grams))
    first = half(F.col("length"))
    new = (F.col("half") == 0) | (F.substr("a", F.lit(1), first) != F.substr("b", F.lit(1), first))
    pairs = chunks.join(grams, ["length", "half", "gram"])
    return pairs.filter(new & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every (word, n)."""
    words = saved(words.select("word", "n"))
    best = near_pairs(words).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("m"), "b")).alias("best"))
    enough = -F.col("best.m") >= times * F.col("n")
    out = words.join(best, words["word"] == best["a"], "left").select(
        "word", F.when(enough, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.m")).alias("form_n")
    )
    out = saved(out)
    last = roots(out.filter("form is not null").select(F.col("form").alias("a"), F.col("word").alias("b")))
    return out.join(last, out["word"] == last["node"], "left").select("word", "form", F.coalesce("label", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    return variants(word_counts(read(spark, sf_dir, "documents"), DAMAGED))


#: DuckDB's levenshtein counts bytes, so letters of two bytes become other signs of one.
_WIDE, _NARROW = "".join(map(chr, range(0xC0, 0x100))), "".join(chr(c) for c in range(33, 127) if chr(c) not in "'" and not chr(c).islower())[:64]
_BYTES = "list_transform(range(strlen(s)), lambda i: CAST(concat('0x', substr(hex(s), 2 * i + 1, 2)) AS BIGINT))"

#: crc32 is not a DuckDB function: the list holds each byte and eight shifts.
ORACLE = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
d AS (SELECT w, concat(doc_id, ':', w) AS s, count(*) AS c FROM r WHERE length(w) >= {LENGTH} GROUP BY doc_id, w),
h AS (SELECT w, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform({_BYTES}, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS h FROM d),
u AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1 HAVING sum(c) >= {LEAST} AND length(word) >= {LENGTH}),
v AS (SELECT *, translate(word, '{_WIDE}', '{_NARROW}') AS plain FROM u),
p AS (SELECT a.word, b.word AS other, b.n FROM v a JOIN v b ON abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word AND levenshtein(a.plain, b.plain) = 1),
m AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS other, max(n) AS top FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {TIMES} * v.n THEN other END AS form, CASE WHEN top >= {TIMES} * v.n THEN top END AS form_n FROM v LEFT JOIN m USING (word)),
t AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT t.word, t.next, f.form FROM t JOIN f ON f.word = t.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON t.word = f.word AND t.next IS NULL
"""
