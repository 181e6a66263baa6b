"""Connected components of an edge table by contraction: nodes join their smallest neighbour, edges within a group vanish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, root: str) -> DataFrame:
    """(node, label) of every node of the edges (a, b); the label is the component's smallest node.

    In each round every node that has edges left points to its smallest
    neighbour, or itself if that is smaller (pre-aggregated in each task, so a
    node with very many neighbours costs no more than its edges), and then to
    where that points. Edges are taken over to the nodes pointed at; what so
    joins a node to itself, or repeats, is dropped, so a star is done after one
    round. Rounds end when no edge is left; each is written to the shared folder.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{root}/edges-0")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), f"{root}/labels-0")
    k = 0
    while left.limit(1).count():
        k += 1
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e"))
        near = stored(ends.groupBy(F.col("e.v").alias("v")).agg(F.min("e.w").alias("w")).select("v", F.least("v", "w").alias("m")), f"{root}/near-{k}")
        far = stored(near.join(near.select(F.col("v").alias("m"), F.col("m").alias("to")), "m").select("v", "to"), f"{root}/far-{k}")
        to = lambda c: far.select(F.col("v").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        moved = left.join(to("a"), "a").join(to("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        labels = stored(labels.join(to("label"), "label", "left").select("node", F.coalesce("label_to", "label").alias("label")), f"{root}/labels-{k}")
        left = stored(moved.where("a <> b").distinct(), f"{root}/edges-{k}")
    return labels
