"""Evidence in documents: deduplication by address, rollups, findings, and what is written back to the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import edge_id, first_sentence, slug


def first_by_url(results: DataFrame) -> DataFrame:
    """The result of the smallest id of each url; rows without url stay as they are."""
    rest = [c for c in results.columns if c != "url"]
    one = results.where("url IS NOT NULL").groupBy("url").agg(F.min_by(F.struct(*rest), "result_id").alias("r")).select("url", "r.*")
    return one.unionByName(results.where("url IS NULL").select("url", *rest))


def mention_rollup(mentions: DataFrame) -> DataFrame:
    """(id, documents, urls, mentions) of each resolved entity: distinct documents and addresses, and all mentions."""
    m = mentions.where("resolved_entity_id IS NOT NULL")
    return m.groupBy(F.col("resolved_entity_id").alias("id")).agg(
        F.count_distinct(F.nullif("document_id", F.lit(""))).alias("documents"), F.count_distinct("source_url").alias("urls"), F.count("*").alias("mentions")
    )


def findings(results: DataFrame, least: float = 0.85, top: int = 8) -> DataFrame:
    """(result_id, finding): first sentences of the best results, of more than 20 characters."""
    f = results.where(F.col("score") >= least).select("result_id", "score", first_sentence(F.col("content")).alias("finding"))
    return f.where(F.length("finding") > 20).orderBy(F.desc("score"), "result_id").limit(top).select("result_id", "finding")


def link_assertions(assertions: DataFrame, decisions: DataFrame) -> DataFrame:
    """assertions (assertion_id, source_mention, target_mention, rel_type, confidence) with the decided ends and a status.

    confirmed if both mentions are linked, else pending; an assertion on a mention that is not there is pending."""
    d = decisions.where("status = 'LINKED'").select("mention_id", "id")
    j = assertions.join(d.select(F.col("mention_id").alias("source_mention"), F.col("id").alias("source_id")), "source_mention", "left")
    j = j.join(d.select(F.col("mention_id").alias("target_mention"), F.col("id").alias("target_id")), "target_mention", "left")
    return j.withColumn("status", F.when(F.col("source_id").isNotNull() & F.col("target_id").isNotNull(), "confirmed").otherwise("pending"))


def new_edges(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, source_id, target_id, rel_type, confidence) of confirmed assertions between two entities that are no edges yet."""
    e = linked.where("status = 'confirmed' AND source_id != target_id").select(
        edge_id(F.col("source_id"), F.col("target_id"), F.col("rel_type")).alias("id"), "source_id", "target_id", "rel_type", "confidence"
    )
    e = e.groupBy("id", "source_id", "target_id", "rel_type").agg(F.max("confidence").alias("confidence"))
    return e.join(edges.select("id"), "id", "left_anti")


def entity_id_for(names: DataFrame, vertices: DataFrame) -> DataFrame:
    """names (name) with id: the vertex of that id, else of that name in any case, else a slug of the name."""
    v = vertices.select(F.col("id").alias("__i"))
    n = vertices.groupBy(F.lower("name").alias("__n")).agg(F.min("id").alias("__by_name"))
    j = names.join(v, F.col("name") == F.col("__i"), "left").join(n, F.lower("name") == F.col("__n"), "left")
    return j.withColumn("id", F.coalesce("__i", "__by_name", slug(F.col("name")))).drop("__i", "__n", "__by_name")


def merge_entities(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, mention_count, urls, attributes) of both: the greater count, all urls, b's attributes over a's."""
    x = a.select("id", *[F.col(c).alias(f"__a_{c}") for c in ("mention_count", "urls", "attributes")])
    y = b.select("id", *[F.col(c).alias(f"__b_{c}") for c in ("mention_count", "urls", "attributes")])
    none, empty = F.array().cast("array<string>"), F.expr("cast(map() as map<string,string>)")
    mine = F.map_filter(F.coalesce("__a_attributes", empty), lambda k, _: ~F.map_contains_key(F.coalesce("__b_attributes", empty), k))
    return x.join(y, "id", "full_outer").select(
        "id",
        F.greatest("__a_mention_count", "__b_mention_count").alias("mention_count"),
        F.array_sort(F.array_union(F.coalesce("__a_urls", none), F.coalesce("__b_urls", none))).alias("urls"),
        F.map_concat(mine, F.coalesce("__b_attributes", empty)).alias("attributes"),
    )


def expand_query(query: str) -> list[str]:
    """Up to three searches for a question."""
    q = " ".join(query.split())
    out = [q, f"{q} latest developments", f"{q} risk assessment"]
    return [x for x in dict.fromkeys(out) if x.strip()][:3]
