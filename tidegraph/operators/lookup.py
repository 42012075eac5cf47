"""Lookups and searches over the vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from ..session import BROADCAST_LIMIT, checkpoint


def by_id(rows: DataFrame, value: str) -> DataFrame:
    return rows.where(F.col("id") == value)


def by_name(rows: DataFrame, name: str) -> DataFrame:
    """The row of that name in any case; of several the earliest created, then the smallest id."""
    order = [c for c in ("created_at",) if c in rows.columns]
    return rows.where(F.lower("name") == name.lower()).orderBy(*order, "id").limit(1)


def by_type(rows: DataFrame, entity_type: str) -> DataFrame:
    return rows.where(F.col("entity_type") == entity_type)


def by_attribute(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of which a base column, a typed field or a free attribute `key` equals the value; a number for confidence."""
    any_: list[Column] = []
    if key in ("id", "name", "description", "source", "entity_type"):
        any_.append(F.col(key) == value)
    if key == "confidence":
        any_.append(F.col("confidence") == F.lit(value).try_cast("double"))
    if "typed" in rows.columns and key in rows.schema["typed"].dataType.names:
        any_.append(F.col(f"typed.{key}").cast("string") == value)
    if "attributes" in rows.columns:
        any_.append(F.col("attributes")[key] == value)
    hit = F.lit(False)
    for c in any_:
        hit = hit | F.coalesce(c, F.lit(False))
    return rows.where(hit)


def search(rows: DataFrame, term: str) -> DataFrame:
    """Rows whose name, description, canonical name or an alias contains the term in any case; '' matches all."""
    if not term:
        return rows
    q = term.lower()
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    return rows.where(has("name") | has("description") | has("canonical_name") | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(q))), F.lit(False)))


def query(rows: DataFrame, entity_type: str | None = None, term: str | None = None) -> DataFrame:
    """By type if one is given, else by term, else all."""
    return by_type(rows, entity_type) if entity_type else search(rows, term) if term else rows


def page(rows: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def capped(rows: DataFrame, cap: int) -> tuple[list, bool]:
    """At most cap rows, and whether there are more."""
    got = rows.limit(cap + 1).collect()
    return got[:cap], len(got) > cap


def gazetteer(vertices: DataFrame) -> DataFrame:
    """(pattern, id, entity_type): lower-case names, canonical names, aliases and ids of at least three characters."""
    forms = F.array_distinct(
        F.transform(
            F.concat(F.array("id", "name", "canonical_name", F.replace("id", F.lit("_"), F.lit(" "))), F.coalesce("aliases", F.array().cast("array<string>"))),
            lambda x: F.lower(F.trim(x)),
        )
    )
    return vertices.select(F.explode(forms).alias("pattern"), "id", "entity_type").where(F.length("pattern") >= 3)


def mentions_in(docs: DataFrame, text: str, key: str, patterns: DataFrame) -> DataFrame:
    """(key, id): entities of which a pattern stands in the text at word borders, by an equi join on word runs.

    Texts are cut into words once; every run of as many words as some pattern has is looked up. Patterns of a checked
    size are broadcast, so that no run is shuffled; more of them meet the runs in a shuffle. Patterns without words match
    nothing."""
    ws = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pat = checkpoint(patterns.select(F.array_join(ws(F.col("pattern")), " ").alias("p"), "id").where("p != ''").distinct())
    sizes = pat.groupBy(F.size(F.split("p", " ")).alias("n")).agg(F.sum(F.length("p") + F.length("id") + 32).alias("bytes")).collect()  # a row a length
    if not sizes:
        return docs.select(key, F.lit(None).cast("string").alias("id")).where("false")
    own = F.broadcast(pat) if sum(r["bytes"] for r in sizes) <= BROADCAST_LIMIT else pat
    lengths = F.array(*[F.lit(r["n"]) for r in sorted(sizes)])
    run = lambda n: F.transform(
        F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("w", i, n), " ")
    )
    parts = let(docs.select(F.col(key), F.col(text).alias("__t")), {"w": ws(F.col("__t"))}).drop("__t")
    runs = parts.select(key, F.explode(F.array_distinct(F.flatten(F.transform(lengths, run)))).alias("p"))
    return runs.join(own, "p").select(key, "id").distinct()
