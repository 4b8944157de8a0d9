"""Connected components of a link table by alternating large-star and small-star steps.

Each step is two shuffles of the links alone; hubs are pre-aggregated before
the join, and AQE splits the hot key of that join. Every round is written to
the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: distinct (a > b). Large star hooks larger neighbours to the least one, small star the smaller ones and the node."""
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        hooked = links.join(least, "a")
        out = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(scratch: Scratch, links: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node that has a link; component is the least node reachable.

    links: columns a, b of one orderable type; rows with a = b or a null are ignored,
    direction and repeats don't matter. No links: an empty table.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, seen, k = scratch.keep(ordered, f"{label}-0"), None, 0
    while True:
        # a star forest is a fixed point of both steps: each node hangs on its least one and roots hang on none
        k += 1
        following = scratch.keep(_star(_star(current, True), False), f"{label}-{k}")
        mark = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.discard(f"{label}-{k - 1}")
        current = following
        if mark == seen:
            break
        seen = mark
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
