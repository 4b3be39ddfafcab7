"""Skew-safe exact deduplication.

Texts are equal when identical after lower-casing A-Z only. Three stages, each of which
compares whole texts: Spark's partial aggregation deduplicates locally, the winners of each
``(digest, salt)`` merge, with a salt that a partition gives all of its rows, and the salts'
winners combine by ``(digest, text)``. So of a text that stands in a third of all rows, each
partition sends one copy, and no task gets more than the partitions of one salt send.

Only digests that occur more than once take their texts through the stages, as a text whose
digest is alone has no equal. Where those digests are few enough to be sent to every task,
no other text is shuffled; beyond that all texts are dealt by digest and salt.

Defined cases: null and empty texts are one value, the empty text; repeated rows and equal
ids are members of one group like any others; a null id never wins against an id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import ascii_lower, read, saved, small_or_shuffled, text_key, without

#: Sub-groups that each digest is spread over before the winners meet.
SALTS = 64
#: Repeated digests that may be sent to every task; more are joined by a shuffle.
MOST_SENT = 100_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text as it is), text_sha256 (of the normalised text) of every row."""
    return docs.select("doc_id", text_key(F.col("text")).alias("key"), F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256"))


def text_groups(docs: DataFrame, salts: int = SALTS, most_sent: int = MOST_SENT) -> DataFrame:
    """One row per repeated text: digest, text, keep_id (largest doc_id), group_size."""
    rows = docs.select("doc_id", ascii_lower(F.col("text")).alias("text")).withColumn("digest", F.sha2("text", 256))
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    twice = docs.select(F.sha2(ascii_lower(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    twice = saved(twice)
    if twice.count() <= most_sent:
        rows = rows.join(F.broadcast(twice), "digest", "left_semi")
    else:
        # Spark's estimate of this side leaves out the salts; without the hint it may be built on the driver
        rows = rows.join(twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge"), ["digest", "salt"], "left_semi")
    merged = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return merged.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, salts: int = SALTS, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, key, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    The repeated texts go back to their rows by digest. Should two different texts ever share
    a digest, the job stops with an error instead of merging them.
    """
    found = text_groups(docs, salts, most_sent).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    alone = F.when(F.col("texts") == 1, F.col("keep_id")).otherwise(F.raise_error(F.lit("two texts with one digest")).cast("long"))
    groups = small_or_shuffled(found.select(F.col("digest").alias("text_sha256"), alone.alias("keep_id"), "group_size"), most_sent)
    keep = F.coalesce("keep_id", "doc_id")
    return digests(docs).join(groups, "text_sha256", "left").select(
        "doc_id", "key", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, salts: int = SALTS, most_sent: int = MOST_SENT) -> DataFrame:
    """The rows of ``docs`` without those that another row's equal text replaces.

    A row is told by its id and its text as it is; of rows that share the largest id one stays,
    with the last text in the order of their hashes.
    """
    rows = exact_groups(docs, salts, most_sent).filter("group_size > 1")
    each = saved(rows.groupBy("text_sha256", "doc_id", "key", "kept").agg(F.count("*").alias("times")))
    last = small_or_shuffled(each.filter("kept").groupBy("text_sha256").agg(F.max(F.struct(F.col("key"))).alias("last")), most_sent)
    kept = F.col("kept") & F.struct(F.col("key")).eqNullSafe(F.col("last"))
    return without(docs, each.join(last, "text_sha256").select(F.col("doc_id").cast("long").alias("doc_id"), "key", kept.alias("kept"), "times"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def query(spark, sf_dir):
    return exact_groups(read(spark, sf_dir, "documents")).drop("key")
