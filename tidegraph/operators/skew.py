"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 5_000  # rows of one key that stay together
MOST_HEAVY = 50_000  # keys that can be heavy at most, whatever the number of rows; so they may be broadcast


def heavy_keys(rows: DataFrame, key: str, total: int, heavy: int = HEAVY) -> DataFrame:
    """(key, __parts): the keys of more rows than `heavy`, and in how many parts each is split.

    The bound rises with the rows, so that there are at most MOST_HEAVY such keys."""
    bound = max(heavy, total // MOST_HEAVY)
    counts = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > bound)
    return counts.select(key, F.ceil(F.col("__n") / bound).cast("int").alias("__parts"))


def skewed_join(left: DataFrame, right: DataFrame, key: str, total: int, heavy: int = HEAVY) -> DataFrame:
    """The inner join on `key`. The rows of a heavy key of `left` (of `total` rows) are split by their hash, those of `right` repeated.

    Null keys meet nothing. `left` is read twice, so it should be a written table or cheap."""
    parts = F.broadcast(heavy_keys(left, key, total, heavy))
    n = F.coalesce("__parts", F.lit(1))
    cut = left.join(parts, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), n).cast("int")).drop("__parts")
    every = right.join(parts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__parts")
    return cut.join(every, [key, "__salt"]).drop("__salt")
