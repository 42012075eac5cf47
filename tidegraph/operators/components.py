"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(node, component): every node of an edge and the smallest node it is connected with.

    Nulls and self-loops connect nothing. Each step only folds neighbours to their minimum, so a hub
    is pre-aggregated before it is shuffled; each round's edges are written to the shared folder and
    the number of rounds grows with the logarithm of the longest path. Raises if `rounds` do not do."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    e = checkpoint(e)
    for _ in range(rounds):
        before = e
        # large star: larger neighbours of u go to the minimum around u
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: smaller neighbours of u and u itself go to the minimum among them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpoint(small.distinct())
        if e.exceptAll(before).isEmpty() and before.exceptAll(e).isEmpty():
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"not connected after {rounds} rounds")
