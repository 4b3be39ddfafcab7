"""Connected components of a graph that is too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import saved


def roots(parents: DataFrame, most: int = 64) -> DataFrame:
    """node, label (the root of its tree) from a forest of edges (a: parent, b), for every node of it.

    Each round every node points to what its parent points to, so rounds grow with the
    logarithm of the depth, one join each.
    """
    now = saved(parents.select(F.col("b").alias("node"), F.col("a").alias("label")))
    for _ in range(most):
        up = now.select(F.col("node").alias("at"), F.col("label").alias("up"))
        step = saved(now.join(up, F.col("label") == F.col("at"), "left").select("node", F.coalesce("up", "label").alias("label"), F.col("up").isNotNull().alias("moved")))
        now = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return now.unionByName(now.select(F.col("label").alias("node"), "label").distinct())
    raise RuntimeError(f"trees are deeper than {most} rounds reach, or no trees")


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """node, label (the smallest node of its component) from edges (a, b).

    Each round every node takes the smallest label among itself and its neighbours, then the
    label of that label; chains halve, so rounds grow with the logarithm of a component's
    length. Every round is written to the checkpoint folder.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(most):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        step = step.join(jump, F.col("next") == F.col("at"), "left").select("node", F.col("label").alias("was"), F.least("next", F.coalesce("jump", "next")).alias("label"))
        step = saved(step)
        changed = step.filter("was <> label").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components didn't settle in {most} rounds")
