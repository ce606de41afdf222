"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, checkpointed, counted


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (columns ``a``, ``b``); label = smallest node of its component.

    Every node hooks onto its smallest neighbour, chains are halved until each
    node points at its root, and the edges are rewritten onto the roots, until
    no edge is left.
    Tables stay distributed; each round is cut by a checkpoint, and pointers of
    few nodes are broadcast, so that a round of a small graph shuffles twice. Self-loops and
    repeated edges are harmless, null ends are dropped.
    """
    live, n = counted(edges.select("a", "b").dropna())
    found = None
    while n:
        both = live.select(F.col("a").alias("x"), F.col("b").alias("y")).union(live.select("b", "a"))
        hooked, nodes = counted(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p")))
        moved = nodes
        while moved:
            over = broadcast_if_few(hooked.select(F.col("x").alias("p"), F.col("p").alias("top")), nodes)
            shorter, moved = counted(hooked.join(over, "p").select("x", F.col("top").alias("p"), (F.col("top") != F.col("p")).alias("moved")),
                                     F.col("moved"))
            hooked = shorter.select("x", "p")
        few = broadcast_if_few(hooked, nodes)
        if found is None:
            found = hooked.select(F.col("x").alias("node"), F.col("p").alias("label"))
        else:
            found = (found.join(few, found["label"] == few["x"], "left")
                     .select("node", F.coalesce("p", "label").alias("label")))
        ends = (live.join(few.select(F.col("x").alias("a"), F.col("p").alias("pa")), "a")
                .join(few.select(F.col("x").alias("b"), F.col("p").alias("pb")), "b"))
        live, n = counted(ends.filter("pa != pb")
                          .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    return checkpointed(found)


def joined(labels: DataFrame, links: DataFrame, nodes: int, n: int) -> DataFrame:
    """``labels`` (at most ``nodes`` rows of ``components``) after ``n`` more edges ``links`` (``a``, ``b``); only these are contracted."""
    if not n:
        return labels
    few = broadcast_if_few(labels, nodes)
    ends = (links.join(few.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
            .join(few.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
            .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    over = components(ends).select(F.col("node").alias("was"), F.col("label").alias("now"))
    some = broadcast_if_few(over, 2 * n)
    moved = labels.join(some, labels["label"] == some["was"], "left").select("node", F.coalesce("now", "label").alias("label"))
    new = over.join(few, over["was"] == few["node"], "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return checkpointed(moved.union(new))
