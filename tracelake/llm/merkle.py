"""Merkle manifest of a dataset: one tree for each language, one tree over their roots.

Nodes of a tree are numbered from 0 at every level. A level is one equi-join of its nodes with
themselves on computed sibling numbers: the number XOR 1 where two children make a parent,
slot offsets (one join for each other slot) where more do. Each row then holds its siblings, and
the rows of slot zero emit the parents. On the way down each node's path is its own siblings and
its parent's path, so a proof is made by one join a level whose rows halve from level to level.
No key is a language alone, so a language that holds most rows is spread like any other.

Leaves are numbered without a window over a language: they are dealt by ranges of
(language, order) and each range adds what the ranges before it hold of the language.

A path is a list of steps from the leaf to the root; a step is one byte with the node's slot,
then the digests of the other children in their order. ``folded`` recomputes the root from a
leaf and a path alone.

Defined cases: null fields are ``-``; leaves without an id come first in their language, leaves
of one id are ordered by their digests, and equal leaves are exchangeable; a null language is a
tree of its own that comes first; a single leaf is its language's root, a single language's root
is the root, and a proof without siblings is the digest of nothing; a row without an id is never
tampered with; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import fold, read, saved, small_or_shuffled

ARITY = 2
#: Hexadecimal digits of a digest.
HEX = 64
#: Levels of paths between two written tables.
WRITTEN = 4
#: Ranges times trees whose offsets may be sent to every task; more are joined by a shuffle.
MOST_SENT = 100_000
#: What a leaf commits to, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(*parts: Column) -> Column:
    """sha256 of the parts one after the other, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves_of(docs: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """doc_id, tree (the language), hash of every row and other: the hash of the row with ``changed`` columns."""
    leaf = lambda of: digest_of(*[field(of.get(c, F.col(c))) for c in FIELDS])
    return docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("tree"), leaf({}).alias("hash"), leaf(changed).alias("other"))


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds idx (place within its tree by ``order``, from 0) and n (nodes of the tree)."""
    by = ["tree", *order]
    dealt = saved(nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    per = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_from"))
    from pyspark.sql import Window

    tree = Window.partitionBy("tree")
    before = F.sum("_c").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    per = small_or_shuffled(per.select(F.col("tree").alias("_t"), F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_add"), F.sum("_c").over(tree).alias("n")), MOST_SENT)
    out = dealt.join(per, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("idx", F.col("_at") + F.col("_add")).drop("_at", "_part", "_t", "_p", "_add")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds step: the slot of each node and the digests of its siblings, in their order."""
    slot = F.col("idx") % arity
    place = lambda s: F.col("idx").bitwiseXOR(1) if arity == 2 else F.col("idx") - slot + (slot + s) % arity
    out, found = nodes, []
    for s in range(1, arity):
        other = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("hash").alias(f"_h{s}"))
        out = out.join(other, (place(s) == F.col("_idx")) & F.col("tree").eqNullSafe(F.col("_tree")), "left").drop("_tree", "_idx")
        found.append(F.when(F.col(f"_h{s}").isNotNull(), F.struct(((slot + s) % arity).alias("slot"), F.col(f"_h{s}").alias("hash"))))
    others = F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda x: F.hex(x["hash"]))
    step = F.unhex(F.concat(F.lpad(F.hex(slot), 2, "0"), F.array_join(others, "")))
    return out.withColumn("step", step).drop(*[f"_h{s}" for s in range(1, arity)])


def parents(level: DataFrame, arity: int) -> DataFrame:
    """tree, idx, n, hash of the next level, from the rows of slot zero."""
    up = digest_of(as_hex(F.col("hash")), F.substr(as_hex(F.col("step")), F.lit(3)))
    return level.filter(F.col("idx") % arity == 0).select("tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), up.alias("hash"))


def build(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each level that have a parent, with their steps; tree, hash, height of every tree's top)."""
    top = lambda nodes, height: nodes.filter("n = 1").select("tree", "hash", F.lit(height).alias("height"))
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, tops, now = [], top(leaves, 0), leaves
    while most > 1:
        levels.append(saved(with_siblings(now.filter("n > 1"), arity)))
        now = parents(levels[-1], arity)
        most = -(-most // arity)
        tops = tops.unionByName(top(now, len(levels)))
    return levels, saved(tops)


def paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The rows of the lowest level with path and what ``tops`` (tree, height, path, ...) say of their tree, from top to bottom.

    Trees of one leaf have no row in a level; they are not among the result.
    """
    carried = [c for c in tops.columns if c not in ("tree", "height", "hash", "path")]
    starts = tops.select("tree", F.lit(0).cast("long").alias("idx"), "path", "height", *carried)
    above = None
    for height in range(len(levels) - 1, -1, -1):
        ends = starts.filter(F.col("height") == height + 1).drop("height")
        above = ends if above is None else above.select("tree", "idx", "path", *carried).unionByName(ends)
        above = above.withColumnsRenamed({"tree": "_tree", "idx": "_idx", "path": "_path"})
        here = levels[height].join(above, (F.expr(f"idx div {arity}") == F.col("_idx")) & F.col("tree").eqNullSafe(F.col("_tree")))
        above = here.withColumn("path", F.concat(F.array("step"), "_path")).drop("_tree", "_idx", "_path")
        if height and height % WRITTEN == 0:
            above = saved(above)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root, in hexadecimal, that a leaf (bytes) and its path lead to."""

    def step(at: Column, x: Column) -> Column:
        x = as_hex(x)
        slot = F.conv(F.substring(x, 1, 2), 16, 10).cast("int")
        return F.sha2(F.concat(F.substr(x, F.lit(3), HEX * slot), at, F.substr(x, 3 + HEX * slot)), 256)

    return F.aggregate(path, as_hex(leaf), step)


def proof_digest(path: Column) -> Column:
    """sha256 of the siblings of all steps as hexadecimal text."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.substr(as_hex(x), F.lit(3))), ""), 256)


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root (bytes), path and other (the leaf of the row with ``changed`` columns) of every row."""
    if not 2 <= arity <= 256:
        raise ValueError("a parent has 2 to 256 children")
    leaves = saved(numbered(saved(leaves_of(docs, changed or {})), ["doc_id", "hash"]))
    levels, tops = build(leaves, arity)
    # the tree over the languages' roots
    roots = numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("hash"), "height"), ["lang"])
    upper, root = build(saved(roots), arity)
    start = root.select("tree", "height", F.array().cast("array<binary>").alias("path"), F.col("hash").alias("root"))
    if upper:
        ends = paths([upper[0].withColumnRenamed("height", "of"), *upper[1:]], start, arity).select("lang", "hash", F.col("of").alias("height"), "path", "root")
    else:
        ends = tops.withColumnRenamed("tree", "lang").crossJoin(F.broadcast(start.select("path", "root")))  # one language, one row
    ends = saved(ends.select(F.col("lang").alias("tree"), "hash", "height", "path", F.col("hash").alias("subroot"), "root"))
    columns = ("doc_id", F.col("hash").alias("leaf"), "other", "subroot", "root", "path")
    alone = leaves.filter("n = 1").drop("n", "idx").join(ends.drop("hash").withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree"))).select(*columns)
    return paths(levels, ends, arity).select(*columns).unionByName(alone) if levels else alone


def query(spark, sf_dir):
    """Every row's proof, and its check where one in seven rows has another n_chars than it had."""
    docs = read(spark, sf_dir, "documents")
    other = F.when(fold(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = manifest(docs, {"n_chars": other}).withColumn("folded_root", folded(F.col("other"), F.col("path")))
    root = as_hex(F.col("root"))
    return rows.select(
        "doc_id", as_hex(F.col("leaf")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"
_LEAF = "sha256(concat({}))".format(", ".join(_FIELD.format(c) for c in FIELDS))

#: crc32 is not a DuckDB function: the list holds each byte and eight shifts.
ORACLE = f"""
WITH RECURSIVE c AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc FROM documents),
l AS (
  SELECT doc_id, lang, {_LEAF} AS leaf,
    {_LEAF.replace('n_chars', '(n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END)')} AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM c),
t AS (
  SELECT 0 AS level, lang, idx, n, leaf AS h FROM l
  UNION ALL
  SELECT level + 1, lang, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY level, lang, idx // 2, n),
s AS (SELECT lang, level AS height, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, idx, n, h FROM s
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 2, n),
w AS (
  SELECT l.*, s.h AS subroot, s.idx AS top, s.height, (SELECT h FROM u WHERE n = 1) AS root FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang),
g AS (
  SELECT doc_id, leaf, level, (w.idx >> level) % 2 AS slot, t.h FROM w JOIN t ON w.lang IS NOT DISTINCT FROM t.lang AND w.n > 1 AND t.level < w.height AND t.idx = xor(w.idx >> t.level, 1)
  UNION ALL
  SELECT doc_id, leaf, height + level, (top >> level) % 2, u.h FROM w JOIN u ON u.n > 1 AND u.idx = xor(top >> level, 1)),
p AS (
  SELECT doc_id, leaf, coalesce(string_agg(h, '' ORDER BY level), '') AS proof, map(list(level), list(slot)) AS slots, map(list(level), list(h)) AS sibs FROM g GROUP BY doc_id, leaf),
v AS (
  SELECT w.doc_id, w.leaf, 0 AS k, w.height + (SELECT max(level) FROM u) AS steps, other AS h, slots, sibs FROM w LEFT JOIN p USING (doc_id, leaf)
  UNION ALL
  SELECT doc_id, leaf, k + 1, steps, sha256(CASE WHEN sibs[k] IS NULL THEN h WHEN slots[k] = 0 THEN concat(h, sibs[k]) ELSE concat(sibs[k], h) END), slots, sibs FROM v WHERE k < steps)
SELECT w.doc_id, w.leaf, w.subroot, w.root, sha256(coalesce(p.proof, '')) AS proof_sha256, v.h AS folded_root, v.h = w.root AS verified
FROM w LEFT JOIN p USING (doc_id, leaf) JOIN v ON v.doc_id = w.doc_id AND v.leaf = w.leaf AND v.k = v.steps
"""
