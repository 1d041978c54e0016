"""Connected components by contraction: every node hooks to its smallest smaller neighbour, chains are shortened, and
the graph between what is left is taken up again. Each round shrinks the graph; nothing gathers at a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import common


def _shorten(hooks: DataFrame) -> DataFrame:
    """Pointer jumping until every node points to one that hooks to nothing."""
    while True:
        on = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        jumped = common.cut(hooks.join(on, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")), "hooks")
        common.drop(hooks)
        moved = not jumped.where("_moved").isEmpty()
        path = jumped.plinth_path
        hooks = jumped.drop("_moved")
        hooks.plinth_path = path
        if not moved:
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for all nodes of edges (a, b)."""
    def upward(df):
        return df.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct()

    graph = common.cut(upward(edges), "edges")
    labels = None
    while not graph.isEmpty():
        hooks = _shorten(common.cut(graph.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")), "hooks"))
        if labels is None:
            labels = hooks
        else:
            on = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
            before, hooked = labels, hooks
            labels = common.cut(labels.join(on, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent")).unionByName(hooks.select("node", "parent")), "labels")
        high = hooks.select(F.col("node").alias("hi"), F.col("parent").alias("a"))
        low = hooks.select(F.col("node").alias("lo"), F.col("parent").alias("_b"))
        after = common.cut(upward(graph.join(high, "hi").join(low, "lo", "left").select("a", F.coalesce("_b", "lo").alias("b"))), "edges")
        common.drop(graph)
        if hooks is not labels:
            common.drop(before, hooked)
        graph = after
    common.drop(graph)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")
    named = labels.select("node", F.col("parent").alias("component"))
    found = common.cut(named.unionByName(named.select(F.col("component").alias("node"), "component").distinct()), "components")
    common.drop(labels)
    return found
