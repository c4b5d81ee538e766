"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hooks the larger (or the smaller) neighbours of each node to the smallest one around it."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if large:
        low = materialise(low, "lowest")  # read from files, so that adaptive execution can split a hub's rows in the join
    hooked = both.join(low, "a")
    if large:
        hooked = hooked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hooked = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return hooked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b: long); root is the smallest node reachable.

    Neighbours are folded by minimum before each shuffle, so a hub costs a row per task; the
    rounds grow with the logarithm of the longest path. Each round is written and read again.
    """
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        edges = materialise(_stars(_stars(edges, True), False), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
