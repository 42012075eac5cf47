"""Columns computed exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns added. A generator stands between them and what uses them, so no predicate
    or projection above repeats their expressions. None of the names may be in df already."""
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{x}`") for x in df.columns], made)
