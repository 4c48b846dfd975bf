"""Redirect chains: the last address of each link, by pointer jumping over a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.session import discard, stored


def followed(links: DataFrame) -> DataFrame:
    """(src, final, hops, loop) of every address that redirects. ``links``: src, dst.

    ``final`` is the first address on the way that does not redirect, ``hops`` the steps to it. An address that runs into a
    loop has neither, and ``loop`` is true. Of several targets of one address the smallest counts; rows without src or dst
    are no redirects, an address that redirects to itself is a loop.

    Each round joins the open rows with the table and doubles their reach, so a chain of n hops takes about log2(n) rounds
    of one shuffle, and only counts reach the driver. A round that closes no row proves that the others run in loops: had one
    of them an end further away, some address on its way would have been closed in this round. Many links to one target meet
    one row of the other side there, so adaptive execution can split them.
    """
    edges = links.where("src is not null and dst is not null").groupBy("src").agg(F.min("dst").alias("to"))
    known = stored(edges, "redirects")
    sources = known.select(F.col("src").alias("__src"))
    first = known.join(sources, F.col("to") == F.col("__src"), "left").select("src", "to", F.lit(1).cast("long").alias("hops"), F.col("__src").isNotNull().alias("open"))
    state = stored(first, "redirects")
    discard(known)
    left = state.where("open").count()
    while left:
        after = state.select(F.col("src").alias("__src"), F.col("to").alias("__to"), F.col("hops").alias("__hops"), F.col("open").alias("__open"))
        jumped = state.where("open").join(after, F.col("to") == F.col("__src")).select("src", F.col("__to").alias("to"), (F.col("hops") + F.col("__hops")).alias("hops"), F.col("__open").alias("open"))
        before, state = state, stored(state.where("not open").unionByName(jumped), "redirects")
        discard(before)
        still = state.where("open").count()
        if still == left:
            break
        left = still
    return state.select("src", F.when(~F.col("open"), F.col("to")).alias("final"), F.when(~F.col("open"), F.col("hops")).alias("hops"), F.col("open").alias("loop"))


def resolved(pages: DataFrame, links: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with final_url, the end of their address's redirects (itself where it has none; null in a loop)."""
    ends = followed(links).select(F.col("src").alias("__src"), F.col("final").alias("__final"), F.col("loop").alias("__loop"))
    joined = pages.join(ends, F.col(url) == F.col("__src"), "left")
    return joined.withColumn("final_url", F.when(F.col("__loop"), None).otherwise(F.coalesce("__final", F.col(url)))).drop("__src", "__final", "__loop")
