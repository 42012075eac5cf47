"""Mentions and assertions out of model answers, and what linking writes back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_surface, unfenced, unit

ANSWER = (
    "mentions array<struct<text:string,mention_id:string,expected_types:array<string>,semantic_role:string,context:string,confidence:string>>,"
    "assertions array<struct<source:string,target:string,type:string,predicate:string,confidence:string>>,"
    "entities array<struct<name:string,type:string,description:string,confidence:string>>,"
    "relationships array<struct<source:string,target:string,type:string,predicate:string,confidence:string>>"
)


def parse_answers(answers: DataFrame, key: str, text: str, default: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(mentions, assertions) of JSON answers, fenced or not, one row per `key`.

    The older shape (entities, relationships) is read as well; an end of an assertion that is no mention becomes
    one. mention_id is the given one or key and normalised text; answers that are no JSON give nothing."""
    a = answers.select(F.col(key).alias("doc"), F.from_json(unfenced(F.col(text)), ANSWER, {"mode": "PERMISSIVE"}).alias("a"))
    new = a.select("doc", F.explode("a.mentions").alias("m")).select(
        "doc", F.col("m.mention_id").alias("given"), F.col("m.text").alias("text"), F.col("m.expected_types").alias("expected_types"), F.col("m.semantic_role").alias("semantic_role"),
        F.col("m.context").alias("context"), unit(F.col("m.confidence"), default).alias("confidence"),
    )
    old = a.select("doc", F.explode("a.entities").alias("e")).select(
        "doc", F.lit(None).cast("string").alias("given"), F.col("e.name").alias("text"), F.array(F.lower("e.type")).alias("expected_types"), F.lit("entity").alias("semantic_role"),
        F.col("e.description").alias("context"), unit(F.col("e.confidence"), default).alias("confidence"),
    )
    pairs = a.select("doc", F.explode(F.concat(F.coalesce("a.assertions", F.array()), F.coalesce("a.relationships", F.array()))).alias("r")).select(
        "doc", F.trim("r.source").alias("source"), F.trim("r.target").alias("target"), F.upper(F.coalesce("r.type", "r.predicate", F.lit("RELATED_TO"))).alias("rel_type"), unit(F.col("r.confidence"), default).alias("confidence")
    )
    pairs = pairs.where("source != '' AND target != ''")
    told = new.unionByName(old).where(F.trim("text") != "")
    surface = lambda c: normalize_surface(F.col(c))
    told = told.withColumn("normalized_text", surface("text"))
    ends = pairs.select("doc", F.explode(F.array("source", "target")).alias("text")).withColumn("normalized_text", surface("text")).dropDuplicates(["doc", "normalized_text"])
    known = told.select("doc", "normalized_text").unionByName(told.where("given IS NOT NULL").select("doc", surface("given").alias("normalized_text"))).distinct()
    more = ends.join(known, ["doc", "normalized_text"], "left_anti")
    mentions = told.unionByName(more, allowMissingColumns=True).withColumn("confidence", F.coalesce("confidence", F.lit(default)))
    mentions = mentions.withColumn("mention_id", F.coalesce("given", F.concat_ws(":", F.col("doc").cast("string"), "normalized_text"))).drop("given")
    names = mentions.select("doc", "normalized_text", "mention_id").unionByName(mentions.select("doc", surface("mention_id").alias("normalized_text"), "mention_id"))
    names = names.groupBy("doc", "normalized_text").agg(F.min("mention_id").alias("mention_id"))
    src = names.select("doc", F.col("normalized_text").alias("__s"), F.col("mention_id").alias("source_mention"))
    dst = names.select("doc", F.col("normalized_text").alias("__t"), F.col("mention_id").alias("target_mention"))
    keyed = pairs.withColumn("__s", surface("source")).withColumn("__t", surface("target"))
    assertions = keyed.join(src, ["doc", "__s"], "left").join(dst, ["doc", "__t"], "left").drop("__s", "__t")
    return mentions, assertions.withColumn("assertion_id", F.xxhash64("doc", "source", "target", "rel_type"))


def adjudicated(decisions: DataFrame, ranked: DataFrame, adjudicate: Callable[[DataFrame], DataFrame] | None, top: int = 5, least: float = 0.75) -> DataFrame:
    """decisions in which adjudicate (best candidates of ambiguous mentions -> (mention_id, id)) has named entities; None changes nothing."""
    if adjudicate is None:
        return decisions
    open_ = decisions.where("status = 'AMBIGUOUS'").select("mention_id")
    best = ranked.where(F.col("rank") <= top).join(open_, "mention_id", "left_semi")
    named = adjudicate(best).select("mention_id", F.col("id").alias("__id")).join(best.select("mention_id", F.col("id").alias("__id")), ["mention_id", "__id"], "left_semi")
    j = decisions.join(named, "mention_id", "left")
    hit = F.col("__id").isNotNull()
    return j.select(
        "mention_id", F.when(hit, "LINKED").otherwise(F.col("status")).alias("status"), F.coalesce("__id", "id").alias("id"),
        F.when(hit, F.greatest("score", F.lit(least))).otherwise(F.col("score")).alias("score"), "margin",
    )


def new_entities(decisions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, name, entity_type, description, source, confidence) for mentions decided NEW; one per normalised name and type.

    The id follows from both, so that a repeated run makes the same entity."""
    m = mentions.join(decisions.where("status = 'NEW'").select("mention_id"), "mention_id", "left_semi")
    m = m.withColumn("entity_type", F.coalesce(F.get("expected_types", F.lit(0)), F.lit("event"))).withColumn("n", normalize_surface(F.col("text")))
    one = m.groupBy("n", "entity_type").agg(F.min(F.struct("mention_id", "text", F.substring("context", 1, 500).alias("context"))).alias("f"), F.max("confidence").alias("confidence"))
    return one.select(
        F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat_ws("|", "n", "entity_type"), 256), 1, 32)).alias("id"), F.col("f.text").alias("name"), "entity_type",
        F.col("f.context").alias("description"), F.lit("linking").alias("source"), "confidence",
    )


def review_queue(decisions: DataFrame, ranked: DataFrame | None = None, keep: int = 10) -> DataFrame:
    """(mention_id, status, candidates): mentions for a person to look at, with their best candidates, of `ranked` or the array `candidates` of decisions."""
    if ranked is None:
        return decisions.where("status IN ('AMBIGUOUS', 'NIL')").select("mention_id", F.slice("candidates", 1, keep).alias("candidates")).withColumn("status", F.lit("pending"))
    c = ranked.where(F.col("rank") <= keep).groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("candidates"))
    return decisions.where("status IN ('AMBIGUOUS', 'NIL')").select("mention_id").join(c, "mention_id", "left").withColumn("status", F.lit("pending"))


def surface_aliases(decisions: DataFrame, mentions: DataFrame, vertices: DataFrame) -> DataFrame:
    """(entity_id, alias, normalized_alias, confidence, verified): texts of linked mentions whose surface is not the entity's name."""
    m = decisions.where("status = 'LINKED'").select("mention_id", F.col("id").alias("entity_id")).join(mentions.select("mention_id", F.col("text").alias("alias"), "confidence"), "mention_id")
    own = vertices.select(F.col("id").alias("entity_id"), normalize_surface(F.col("name")).alias("__own"))
    j = m.join(own, "entity_id").withColumn("normalized_alias", normalize_surface(F.col("alias")))
    return j.where((F.col("normalized_alias") != "") & ~F.col("normalized_alias").eqNullSafe(F.col("__own"))).select("entity_id", "alias", "normalized_alias", "confidence", F.lit(False).alias("verified"))


def pending_reviews(reviews: DataFrame, mentions: DataFrame, status: str = "pending") -> DataFrame:
    """reviews of the status with the columns of their mentions; a review of a mention that is not there has none."""
    own = mentions.drop(*[c for c in reviews.columns if c != "mention_id"])
    return reviews.where(F.col("status") == status).join(own, "mention_id", "inner")


def start_run(runs: DataFrame, run: DataFrame) -> DataFrame:
    """runs with the run unless its run_id is there."""
    return runs.unionByName(run.join(runs.select("run_id"), "run_id", "left_anti"), allowMissingColumns=True)


def threat_findings(threats: DataFrame, precedents: DataFrame, top: int = 3) -> DataFrame:
    """(finding): the gravest threats, and the most relevant precedent."""
    from .risk import severity_rank

    t = threats.orderBy(severity_rank(F.col("severity")).desc(), F.desc("confidence"), "category").limit(top)
    a = t.select(F.format_string("%s threat of %s severity (confidence %.2f)", "category", "severity", "confidence").alias("finding"))
    b = precedents.agg(F.max_by("title", F.struct("relevance", "title")).alias("t")).where("t IS NOT NULL").select(F.concat(F.lit("Precedent: "), "t").alias("finding"))
    return a.unionByName(b)
