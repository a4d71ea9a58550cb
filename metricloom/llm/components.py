"""Connected components of an undirected edge list, by alternating star contractions.

Each round links every node to the smallest node it knows (large star: neighbours above the
node, small star: neighbours below it).  The rounds stop when the edges form stars; their
number grows with the logarithm of the nodes.  Edges of a round are written to the shared
folder, which cuts the lineage.  A node with very many neighbours is a key of aggregations
with map-side combine and of joins that Spark may split, never one group in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import written


def _linked_to_smallest(edges: DataFrame, both: bool) -> DataFrame:
    """Move the neighbours of every node to the smallest of the node and its neighbours."""
    if both:  # large star: all neighbours known, those above the node move
        known = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # small star: only neighbours below; they and the node move
        known = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = known.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = known.join(least, "a")
    if both:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node with an edge.

    ``edges`` has long columns ``a`` and ``b``; loops and repeats do no harm.
    """
    current = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        large = _linked_to_smallest(current, both=True)
        current = written(_linked_to_smallest(large, both=False), "edges")
        now = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"Components did not settle in {rounds} rounds.")
