"""Connected components of a link table, by hooking each node to its smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.workspace import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``links`` (columns ``a``, ``b`` of type long; either order, repeats and loops allowed).

    Each round hooks every node to the least of itself and its neighbours, shortens chains of hooks twice, and replaces both ends
    of each link; links within a node vanish.  Links stay in tables of the workspace; the driver sees a count a round.  A table without links, or
    with loops alone, gives no rows; links with a null end count for nothing; other columns are ignored.
    """
    edges = work.table(links.select("a", "b").where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = work.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to")))
        for _ in range(2):
            above = hook.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
            shorter = work.table(hook.join(above, hook["to"] == F.col("n2"), "left").select("node", F.coalesce("t2", "to").alias("to")))
            work.drop(hook)
            hook = shorter
        if label is None:
            new = work.table(hook.select("node", F.col("to").alias("component")))
        else:
            new = work.table(label.join(hook.withColumnRenamed("node", "n2"), F.col("component") == F.col("n2"), "left").select("node", F.coalesce("to", "component").alias("component")))
            work.drop(label)
        label = new
        at = lambda c: hook.select(F.col("node").alias(f"n{c}"), F.col("to").alias(f"t{c}"))  # noqa: B023, E731
        moved = edges.join(at("a"), F.col("a") == F.col("na")).join(at("b"), F.col("b") == F.col("nb")).select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        rest = work.table(moved.where("a != b").distinct())
        work.drop(edges, hook)
        edges = rest
    work.drop(edges) if label is not None else None
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
