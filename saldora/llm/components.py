"""Connected components by contraction; edges and labels stay in tables, only counts come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldora.llm.common import stash


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), two long columns; root is the smallest id of the component.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks four deep, and
    contracts the graph to what is left between different roots; edges that became equal are merged before the
    shuffle. A path shrinks to a quarter in each round, a star to nothing in one."""
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    labels = stash(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root")), "cc-labels")
    while edges.limit(1).count():
        hook = stash(edges.groupBy("a").agg(F.min("b").alias("b")), "cc-hooks")
        for _ in range(2):
            then = hook.select(F.col("a").alias("b"), F.col("b").alias("c"))
            hook = stash(hook.join(then, "b", "left").select("a", F.coalesce("c", "b").alias("b")), "cc-hooks")
        to = hook.select(F.col("a").alias("root"), F.col("b").alias("next"))
        labels = stash(labels.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-labels")
        up = edges.join(to.withColumnsRenamed({"root": "a", "next": "x"}), "a", "left").join(to.withColumnsRenamed({"root": "b", "next": "y"}), "b", "left")
        up = up.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b")
        edges = stash(up.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    return labels
