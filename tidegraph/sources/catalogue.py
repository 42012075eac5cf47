"""Threats and precedents for an assessment, out of the entities; and vectors for texts where no model is at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threat_catalogue(entities: DataFrame) -> DataFrame:
    """(id, category, severity, confidence, description) of the threats."""
    t = entities.where("entity_type = 'threat'")
    return t.select("id", F.col("typed.threat_type").alias("category"), F.col("typed.severity").alias("severity"), F.col("typed.likelihood").alias("confidence"), "description")


def precedents(entities: DataFrame) -> DataFrame:
    """(id, title, relevance): past events; how relevant one is is the confidence in it, 0 if that is no number."""
    from ..functions.text import unit

    e = entities.where("entity_type = 'event'")
    return e.select("id", F.col("name").alias("title"), unit(F.col("confidence")).alias("relevance"))


DIMENSIONS = 32  # hex digits of an MD5


def hashed_vector(text: Column) -> Column:
    """array<double> of DIMENSIONS: the stand-in for an embedding model. The same words give the same direction, in any order.

    Each word adds the digits of its MD5, 0 to 15 less 7.5; the sum has length 1. A text without words gives []."""
    ws = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    digits = lambda w: F.transform(F.split(F.md5(w), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 8.5)
    sums = F.aggregate(ws, F.array_repeat(F.lit(0.0), DIMENSIONS), lambda s, w: F.zip_with(s, digits(w), lambda x, y: x + y))
    return F.when(F.size(ws) > 0, _normal(sums)).otherwise(F.array().cast("array<double>"))


def _normal(v: Column) -> Column:
    """v of length 1; a sum of nothing stays."""
    return F.aggregate(F.array(v), F.array().cast("array<double>"), lambda _, x: _scaled(x))


def _scaled(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.aggregate(F.array(n), F.array().cast("array<double>"), lambda _, m: F.transform(v, lambda x: F.when(m > 0, x / m).otherwise(x)))
