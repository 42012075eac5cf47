"""Scalar functions of names, texts and scores, as column expressions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_KEEP = r"[^\p{L}\p{N}\p{M}_\x{3400}-\x{9fff}]+"


def normalize_surface(text: Column) -> Column:
    """NFKC, case folded, every run of other characters than word characters and Han one blank, trimmed.

    ASCII texts stay in the JVM; null stays null."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_]+", " "))

    @F.arrow_udf("string")
    def folded(rows: pa.Array) -> pa.Array:
        return pa.array([x and unicodedata.normalize("NFKC", x).casefold() for x in rows.to_pylist()], type=pa.string())

    ascii_ = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(ascii_, plain).otherwise(F.trim(F.regexp_replace(folded(F.when(~ascii_, text)), _KEEP, " ")))


def compact_surface(text: Column) -> Column:
    return F.replace(normalize_surface(text), F.lit(" "), F.lit(""))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word of letters and digits, padded by two blanks before and one after."""
    ws = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        ws,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(grams))


def padded_words(text: Column) -> Column:
    """The words that `trigrams` looks at, each after two blanks and before one."""
    ws = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.transform(ws, lambda w: F.concat(F.lit("  "), w, F.lit(" "))), "")


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams; 0 if neither has any; null if either is null."""
    x, y = trigrams(a), trigrams(b)
    both, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(every == 0, 0.0).otherwise(both / every)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of a with b (not symmetric); null if either is null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for null, empty, all-zero vectors and for unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def unit(value: Column, default: float = 0.0) -> Column:
    """value as a double clamped to 0..1; default where it is no number."""
    v = value.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(v), v), F.lit(default))))


def slug(text: Column) -> Column:
    """Lower case, other than a-z0-9 runs to _, outer _ off, 48 characters; null and blank give null."""
    return F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 48), F.lit(""))


def edge_id(source: Column, target: Column, rel_type: Column) -> Column:
    return F.concat_ws("_", F.lit("osint"), source, target, F.when(rel_type != "RELATED_TO", rel_type))


def content_text(*parts: Column) -> Column:
    """The parts that are not blank, one a line."""
    return F.concat_ws("\n", *[F.when(F.trim(p) != "", p) for p in parts])


def content_hash(*parts: Column) -> Column:
    return F.sha2(content_text(*parts), 256)


def first_sentence(text: Column) -> Column:
    return F.concat(F.substring_index(F.trim(text), ". ", 1), F.lit("."))


def bullet_lines(text: Column, limit: int = 5, least: int = 20) -> Column:
    """Up to `limit` lines of more than `least` characters without their bullets; the whole text if there is none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:\d+[.)]|[-*•])\s*", "")))
    long = F.slice(F.filter(lines, lambda x: F.length(x) > least), 1, limit)
    return F.when(F.size(long) > 0, long).otherwise(F.array(F.trim(F.coalesce(text, F.lit("")))))


def unfenced(text: Column) -> Column:
    """A model's JSON without the fence around it."""
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def risk_band(score: Column) -> Column:
    """CRITICAL from 0.8, HIGH 0.6, ELEVATED 0.4, GUARDED 0.2, else LOW."""
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.4, "ELEVATED").when(score >= 0.2, "GUARDED").otherwise("LOW")


def bar(score: Column) -> Column:
    return F.repeat(F.lit("#"), F.floor(score * 20).cast("int"))


def fuse(exact: Column, fulltext: Column, vector: Column, fuzzy: Column, type_: Column, coherence: Column) -> Column:
    """Weighted sum of the clamped signals; at least 0.97 for an exact name of the right type."""
    e, f, v, z, t, c = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)))) for x in (exact, fulltext, vector, fuzzy, type_, coherence))
    score = F.round(F.round(0.35 * e + 0.15 * f + 0.20 * v + 0.15 * z + 0.10 * t + 0.05 * c, 8), 4)  # halves are halves whatever the order of the sum
    return F.when((exact >= 1) & (type_ > 0), F.greatest(score, F.lit(0.97))).otherwise(score)


def truncated(text: Column, most: int) -> Column:
    """At most that many characters from the start."""
    return F.substring(text, 1, most)


def numbered(items: Column) -> Column:
    """array<string>: each item after its number."""
    return F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
