"""Exact density clusters (core points, border points, noise) over any number of numeric columns, without pair tables.

Space is cut into cells of side eps / sqrt(d), so all members of a cell lie within eps of each
other: a cell of ``min_points`` members is core throughout, and all core members of a cell are one
cluster. Cells that can touch meet by an equi-join on wider cells of the first columns. Only
points of sparse cells, fewer than ``min_points`` each, are compared with points at all.

Whether two cells' core points touch is settled on boxes: each side's bounding boxes are split
until some pair lies surely within eps or none can. What is left after a few splits is compared by
distinct points. A cell of a million equal points is one box with one point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.lineage import cut_lineage
from tracelake.operators.graph import smallest_labels

#: Columns that candidate cells are joined by, and splits of boxes before points are compared.
JOINED, SPLITS = 3, 4


def _gap(a: Column, b: Column) -> Column:
    return F.greatest(a, b, F.lit(0.0))


def _squares(parts: list[Column]) -> Column:
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def density_clusters(df: DataFrame, key: str, columns: Sequence[str], eps: float = 0.5, min_points: int = 5, rounds: int = 200) -> DataFrame:
    """key, cluster: the smallest core key of its cluster; null for noise and for rows with a null or NaN column.

    A point's neighbours lie within eps and count the point itself; a border point of several
    clusters takes the smallest. Keys are unique.
    """
    d = len(columns)
    side, far = eps / math.sqrt(d), eps * eps
    x = [f"x{i}" for i in range(d)]
    known = [F.col(c).cast("double") for c in columns]
    points = df.select(F.col(key).alias("k"), *[c.alias(n) for c, n in zip(known, x, strict=True)])
    for n in x:
        points = points.filter(F.col(n).isNotNull() & ~F.isnan(n))
    points = cut_lineage(points.withColumn("cell", F.array(*[F.floor(F.col(n) / side) for n in x])))
    cells = cut_lineage(points.groupBy("cell").agg(F.count("*").alias("n"), *[F.min(n).alias(f"l{i}") for i, n in enumerate(x)], *[F.max(n).alias(f"h{i}") for i, n in enumerate(x)]))
    near = cut_lineage(_near_cells(cells, d, far, eps))
    dense = F.col("n") >= min_points
    sparse = points.join(cells.filter(~dense).select("cell", "n"), "cell").withColumnsRenamed({"cell": "own", "k": "p", **{n: f"p{i}" for i, n in enumerate(x)}})
    distance = _squares([F.col(n) - F.col(f"p{i}") for i, n in enumerate(x)])
    other = near.filter("own <> cell")

    # core: whole dense cells, and points of sparse cells with enough neighbours
    around = sparse.join(other, "own").join(points.drop("k"), "cell").filter(distance <= far).groupBy("p").agg(F.count("*").alias("c"))
    some = sparse.select("p", "own", "n").join(around, "p", "left").filter(F.col("n") + F.coalesce("c", F.lit(0)) >= min_points).select(F.col("p").alias("k"))
    core = cut_lineage(points.join(cells.filter(dense).select("cell"), "cell", "left_semi").unionByName(points.join(some, "k", "left_semi").select(*points.columns)))
    heads = cut_lineage(core.groupBy("cell").agg(F.min("k").alias("head")))

    links = _touching(core, other.filter("own < cell").join(heads.select("cell"), "cell", "left_semi").join(heads.select(F.col("cell").alias("own")), "own", "left_semi"), x, far, side)
    named = links.join(heads.withColumnsRenamed({"cell": "own", "head": "a"}), "own").join(heads.withColumnRenamed("head", "b"), "cell").select("a", "b")
    labels = smallest_labels(cut_lineage(named.unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b")))), rounds)
    cluster = heads.join(labels, heads["head"] == labels["node"], "left").select("cell", F.least("head", F.coalesce("label", "head")).alias("cluster"))

    # border points stand in sparse cells only
    inner = core.select("k", "cell").join(cluster, "cell").select("k", "cluster")
    rest = sparse.join(core.select(F.col("k").alias("p")), "p", "left_anti")
    border = rest.join(near, "own").join(core.drop("k"), "cell").filter(distance <= far).select("p", "cell").distinct().join(cluster, "cell").groupBy("p").agg(F.min("cluster").alias("cluster"))
    found = inner.unionByName(border.select(F.col("p").alias("k"), "cluster"))
    return df.select(key).join(found.withColumnRenamed("k", key), key, "left")


def _near_cells(cells: DataFrame, d: int, far: float, eps: float) -> DataFrame:
    """own, cell of every two occupied cells (a cell and itself too) whose points' boxes come within eps."""
    first = range(min(d, JOINED))
    wide = [F.floor(F.col(f"l{i}") / (2 * eps)).alias(f"w{i}") for i in first]  # a cell's box is narrower than eps
    shifts = F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(step)]) for step in product((-1, 0, 1), repeat=len(first))])).alias("s")
    mine = cells.select(F.col("cell").alias("own"), *[F.col(f"{e}{i}").alias(f"m{e}{i}") for e in "lh" for i in range(d)], *wide, shifts)
    mine = mine.select("own", *[f"m{e}{i}" for e in "lh" for i in range(d)], *[(F.col(f"w{i}") + F.col(f"s.s{i}")).alias(f"w{i}") for i in first])
    theirs = cells.select("cell", *[f"{e}{i}" for e in "lh" for i in range(d)], *wide)
    gap = _squares([_gap(F.col(f"l{i}") - F.col(f"mh{i}"), F.col(f"ml{i}") - F.col(f"h{i}")) for i in range(d)])
    return mine.join(theirs, [f"w{i}" for i in first]).filter(gap <= far).select("own", "cell")


def _touching(core: DataFrame, pairs: DataFrame, x: list[str], far: float, side: float) -> DataFrame:
    """own, cell of the pairs of cells that have core points within eps of each other."""
    done, open_ = None, pairs.select("own", "cell", F.array().cast("array<bigint>").alias("so"), F.array().cast("array<bigint>").alias("sc"))
    for split in range(SPLITS + 1):
        width = side / (1 << split)
        parts = lambda w: F.array(*[F.floor(F.col(n) / w) for n in x])
        box = [F.min(n).alias(f"l{i}") for i, n in enumerate(x)] + [F.max(n).alias(f"h{i}") for i, n in enumerate(x)]
        up = F.array().cast("array<bigint>") if split == 0 else parts(2 * width)
        boxes = cut_lineage(core.withColumns({"up": up, "s": parts(width)}).groupBy("cell", "up", "s").agg(*box))
        ends = [f"{e}{i}" for e in "lh" for i in range(len(x))]
        mine = boxes.select(F.col("cell").alias("own"), F.col("up").alias("so"), F.col("s").alias("no"), *[F.col(c).alias(f"m{c}") for c in ends])
        theirs = boxes.select("cell", F.col("up").alias("sc"), F.col("s").alias("nc"), *ends)
        met = open_.join(mine, ["own", "so"]).join(theirs, ["cell", "sc"])
        least = _squares([_gap(F.col(f"l{i}") - F.col(f"mh{i}"), F.col(f"ml{i}") - F.col(f"h{i}")) for i in range(len(x))])
        most = _squares([F.greatest(F.col(f"h{i}") - F.col(f"ml{i}"), F.col(f"mh{i}") - F.col(f"l{i}")) for i in range(len(x))])
        met = cut_lineage(met.filter(least <= far).select("own", "cell", F.col("no").alias("so"), F.col("nc").alias("sc"), (most <= far).alias("sure")))
        sure = met.filter("sure").select("own", "cell").distinct()
        done = sure if done is None else done.unionByName(sure)
        open_ = cut_lineage(met.join(sure, ["own", "cell"], "left_anti").select("own", "cell", "so", "sc"))
        if open_.isEmpty():
            return done
    last = core.drop("k").distinct().withColumn("s", F.array(*[F.floor(F.col(n) / width) for n in x]))
    mine = last.select(F.col("cell").alias("own"), F.col("s").alias("so"), *[F.col(n).alias(f"p{i}") for i, n in enumerate(x)])
    met = open_.join(mine, ["own", "so"]).join(last.withColumnRenamed("s", "sc"), ["cell", "sc"])
    close = met.filter(_squares([F.col(n) - F.col(f"p{i}") for i, n in enumerate(x)]) <= far)
    return done.unionByName(close.select("own", "cell").distinct())
