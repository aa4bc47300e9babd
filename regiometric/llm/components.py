"""Connected components of a graph given by its links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometric.session import stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` for every node that has a link to another; ``root`` is one node of the component.

    Each round every node picks the smallest of its neighbours and itself, twice over, and the links between picked
    nodes go on to the next round. A component loses at least half of its nodes a round. Only links between distinct
    nodes are kept, so a node with very many neighbours is one partial minimum. Nothing but the question whether links
    are left goes to the driver. Links with a null end are left out; no links give an empty table.
    """
    ends = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    whole = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    left = stage(ends.filter(links[a].isNotNull() & links[b].isNotNull()).filter(whole).distinct(), "links")
    first = left.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b"))
        near = stage(near.select(F.col("a").alias("node"), F.least("a", "b").alias("next")), "parents")
        further = near.select(F.col("node").alias("next"), F.col("next").alias("root"))
        step = stage(near.join(further, "next").select("node", "root"), "parents")
        labels = step if labels is None else _follow(labels, step)
        pick_a = step.select(F.col("node").alias("a"), F.col("root").alias("pa"))
        pick_b = step.select(F.col("node").alias("b"), F.col("root").alias("pb"))
        moved = left.join(pick_a, "a").join(pick_b, "b").filter("pa <> pb")
        left = stage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    return first if labels is None else labels


def _follow(labels: DataFrame, step: DataFrame) -> DataFrame:
    onward = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
    return labels.join(onward, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
