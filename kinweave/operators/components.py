"""Connected components by smallest label, with roots hooked to smaller ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.storage import shuffled, stored


def flattened(labels: DataFrame) -> DataFrame:
    """``labels`` (node, label) with every label replaced by its own label, until nothing moves."""
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        jumped = labels.join(shuffled(jump), "label").select("node", F.col("beyond").alias("label"), (F.col("beyond") != F.col("label")).alias("moved"))
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every end of an edge; the label is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, if that is smaller than itself, and follows the hooks to their
    ends, the roots. The edges between different roots are the next round's edges; without any, the components are whole.
    A round leaves only the nodes without a smaller neighbour, and following takes the logarithm of a hook chain's length,
    so chains of any width settle in few rounds. Only edges and labels move; nothing is gathered by component.
    Edges with a null end are left out.
    """
    ends = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    ends = stored(ends.select(F.greatest("node", "other").alias("high"), F.least("node", "other").alias("low")).distinct(), "edges")
    alone = ends.where("high = low").select(F.col("high").alias("node"))
    open_ = ends.where("high <> low")
    rounds: list[DataFrame] = []
    while not open_.isEmpty():
        hooks = open_.select(F.col("high").alias("node"), F.col("low").alias("label")).unionByName(open_.select(F.col("low").alias("node"), F.col("low").alias("label")))
        rounds.append(flattened(stored(hooks.groupBy("node").agg(F.min("label").alias("label")), "hooks")))
        highs, lows = (rounds[-1].select(F.col("node").alias(end), F.col("label").alias(f"{end}_root")) for end in ("high", "low"))
        moved = open_.join(highs, "high").join(lows, "low").where("high_root <> low_root")
        open_ = stored(moved.select(F.greatest("high_root", "low_root").alias("high"), F.least("high_root", "low_root").alias("low")).distinct(), "edges")
    if not rounds:
        return alone.select("node", F.col("node").alias("label"))
    labels = rounds.pop()
    # a round's labels are the next round's nodes, as far as they had edges left
    while rounds:
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = stored(rounds.pop().join(later, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
    return labels.unionByName(alone.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
