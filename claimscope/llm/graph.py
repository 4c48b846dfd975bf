"""Connected components by alternating star contraction, on stored edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import discard, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _hung(edges: DataFrame, up: bool) -> DataFrame:
    """One star step: hang a node's larger (``up``) or smaller neighbours on its smallest neighbour."""
    if up:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
    # by shuffle, here and in all joins of links: nodes grow with the corpus, so a broadcast of them would fill the driver
    joined = both.join(least.hint("merge"), F.col("a") == F.col("u"))
    if up:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); the root is the component's smallest node.

    Work per round is a few shuffles of the edges; the number of rounds grows with the logarithm of the component
    size. Nothing but a count and a checksum reaches the driver. No links: no rows.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        before, edges = edges, stored(_hung(_hung(edges, up=True), up=False), "edges")
        discard(before)
        after = _state(edges)
        if after == state:
            break
        state = after
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
