"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each round's edges are written to the shared folder, so lineage stays short and a lost
executor costs a re-read at most. The number of rounds grows with the logarithm of a
component's size; the driver only sees two numbers a round.

Defined results: repeated edges count once and an edge from a node to itself not at all, so a node that
has no other is not in the result; edges with a null end join nothing; nodes that can't be reached from
one another never share a root; no edges give no rows; other columns than a and b are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one orderable type); root is the least node reachable."""
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.cut(both)
    sign = _sign(now)
    while sign[0]:
        sym = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a")
        small = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = scratch.cut(small)
        again = _sign(after)
        scratch.drop(now)
        now = after
        if again == sign:
            break
        sign = again
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
