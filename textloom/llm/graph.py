"""Connected components of a stored table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for all nodes of ``links`` (a, b of any one ordered type).

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends, halving the paths,
    and replaces the nodes of the links by these ends, so the graph shrinks until no link is left.
    Every step is stored.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        hooks = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")))
        moving = True
        while moving:
            onward = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = stored(hooks.join(onward, "to").select("node", "next", (F.col("next") != F.col("to")).alias("moved")))
            moving = not jumped.where("moved").isEmpty()
            hooks = jumped.select("node", F.col("next").alias("to"))
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("component"))
        else:
            moved = hooks.select(F.col("node").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        labels = stored(labels)
        for side in ("a", "b"):
            edges = edges.join(hooks.select(F.col("node").alias(side), F.col("to").alias(f"{side}2")), side)
        edges = stored(
            edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
