"""Small Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows to leave out that may be sent to every task; more are joined by a shuffle.
MOST_SENT = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower())


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def text_key(text: Column) -> Column:
    """Tells texts apart; null for a null text."""
    return F.sha2(text, 256)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those decided against, and identical kept rows once.

    decided: doc_id, key (of the text), kept, times (rows of that id and text); rows that it
    doesn't name stay as they are. Only the rows that go, and those that repeat, are looked up.
    """
    decided = saved(decided.filter("not kept or times > 1"))
    key, doc = fresh(docs, "text_key"), F.col("doc_id").cast("long")
    rows = docs.withColumn(key, text_key(F.col("text")))
    same = lambda these: doc.eqNullSafe(these["_id"]) & F.col(key).eqNullSafe(these["_key"])
    gone, again = (small_or_shuffled(decided.filter(c).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")), MOST_SENT) for c in ("not kept", "kept"))
    left = rows.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        repeated = left.join(again, same(again), "left_semi").dropDuplicates(["doc_id", key])
        left = left.join(again, same(again), "left_anti").unionByName(repeated)
    return left.select(docs.columns)


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset (tests), a folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if given is None:
        import tempfile

        given = context.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(given)
    return given


def saved(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: no lineage left, and any executor can read it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tracelake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, most: int) -> DataFrame:
    """The rows, written, marked for a broadcast where they are ``most`` at most, and else for a join that never sends them: a file is far smaller than its rows in memory."""
    df = saved(df)
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers' path.

    Workers stay for later tasks, so each gives back the memory that it has freed.
    """
    ship(df.sparkSession)

    def bounded(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(bounded, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
