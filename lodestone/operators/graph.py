"""Fixpoints over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import staged


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) of all nodes that each seed reaches by edges (src, dst); a seed itself only through a cycle.

    Frontier by frontier: each round joins only what the last one found, is staged,
    and leaves out what is known. Sets sharing a node are found once for each seed.
    """
    step = edges.select("src", "dst").distinct()
    frontier = seeds.select(F.col("node").alias("seed"), F.col("node")).distinct()
    known = frontier.limit(0)
    while True:
        new = frontier.join(step, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct().join(known, ["seed", "node"], "left_anti")
        frontier = staged(new, "frontier")
        if frontier.isEmpty():
            return known
        known = staged(known.unionByName(frontier), "closure")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of undirected edges (src, dst) is linked to.

    Round by round each node points to its smallest neighbour, pointers are followed to
    their ends, and the ends become the nodes of the next round, with the distinct edges
    between them. What is left shrinks, so all rounds shuffle little more than the
    first; the last round's pointers are then applied to those before it.
    """
    left = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    rounds = []
    while True:
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        to = staged(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")), "pointers")
        if to.isEmpty():
            break
        while True:
            moved = to.where("component <> node").select(F.col("node").alias("component"), F.col("component").alias("far"))
            if to.where("component <> node").join(moved, "component", "left_semi").isEmpty():
                break
            to = staged(to.join(moved, "component", "left").select("node", F.coalesce("far", "component").alias("component")), "pointers")
        rounds.append(to)
        ends = lambda df, c: df.join(to.select(F.col("node").alias(c), F.col("component").alias("end")), c).drop(c).withColumnRenamed("end", c)
        ended = ends(ends(left, "src"), "dst").where("src <> dst")
        left = staged(ended.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    if not rounds:
        return to
    labels = rounds.pop()
    while rounds:
        further = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        labels = staged(rounds.pop().join(further, "component", "left").select("node", F.coalesce("far", "component").alias("component")), "labels")
    return labels
