"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HOT_KEYS = 1000   # keys with more than a thousandth of the rows: at most so many


def _lookup(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row for every key; the rows of hot keys are looked up by broadcast.

    The root of a very large component is asked for by all its nodes; a shuffle would send them to one task.
    """
    hot = left.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > max(1, total // HOT_KEYS)).select(key).checkpoint()
    if hot.isEmpty():
        return left.join(right, key)
    hot = F.broadcast(hot)   # at most HOT_KEYS rows
    found = left.join(F.broadcast(right.join(hot, key, "left_semi")), key)
    return found.unionByName(left.join(hot, key, "left_anti").join(right, key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of ``edges``; the label is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours (aggregated map-side, so a node with very
    many links costs one row per task) and then follows the label's own label once.  The state is
    checkpointed every round; rounds grow with the logarithm of the longest shortest path.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    both = e.union(e.select("b", "a")).checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = labels.select("node", F.least("node", "m").alias("label")).checkpoint()
    links, nodes = both.count(), labels.count()
    while True:
        near = (_lookup(both, labels.select(F.col("node").alias("b"), "label"), "b", links)
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m")))
        step = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("new")).checkpoint()
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        # A label is itself a node of the table, so every row finds its label's label.
        nxt = _lookup(step, jump, "new", nodes).select("node", "label", F.least("new", "far").alias("new")).checkpoint()
        labels = nxt.select("node", F.col("new").alias("label"))
        if nxt.filter("new <> label").isEmpty():
            return labels
