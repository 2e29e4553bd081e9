"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import durable, looked_up


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, label) from (node, label), a forest whose roots point to themselves: the root of every node, by pointer
    jumping, which halves the paths each time."""
    while True:
        target = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = durable(looked_up(hooks, target, "label"))
        hooks = jumped.select("node", F.col("next").alias("label"))
        if jumped.where("label <> next").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node long, label long) for every end of edges (a long, b long): label is the least node reachable.

    Rounds of contraction: every node hooks to its least neighbour, if that is less than itself, and gets the root of its
    hooks as label. Edges are then rewritten to labels, and those within one label go. Only nodes whose neighbours are all
    greater are left after a round, and rounds go on until no edge is. The labels of the rounds are looked up one after the
    other in the end. Minimum aggregates combine before the shuffle, and look-ups deal a hub's rows apart (see
    looked_up). Only counts come to the driver; each step is checkpointed. Loops (a = b) and repeated edges are harmless;
    an empty input gives an empty result.
    """
    e = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    e = durable(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not rounds or not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = _roots(durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))))
        rounds.append(labels)
        for end in ("a", "b"):
            e = durable(looked_up(e, labels.select(F.col("node").alias(end), "label"), end).drop(end).withColumnRenamed("label", end), few=True)
        e = durable(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    out = rounds[0]
    for labels in rounds[1:]:
        deeper = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        out = durable(looked_up(out, deeper, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
    return out
