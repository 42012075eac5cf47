"""The graph of the domain tables, and sources and sinks around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import Graph
from ..session import table

TYPED_FIELDS = (
    "org_type", "country", "sector", "revenue_usd", "role", "nationality", "affiliation", "latitude", "longitude", "location_type",
    "event_type", "start_date", "end_date", "severity", "asset_type", "operator", "status", "threat_type", "likelihood", "impact_description",
)
_NUMBERS = ("revenue_usd", "latitude", "longitude", "likelihood")
_TEXTS, _MAP = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())

ENTITY = T.StructType(
    [T.StructField("id", T.StringType(), False), T.StructField("entity_type", T.StringType()), T.StructField("name", T.StringType()),
     T.StructField("canonical_name", T.StringType()), T.StructField("aliases", _TEXTS), T.StructField("lang", T.StringType()),
     T.StructField("external_ids", _MAP), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("description", T.StringType()),
     T.StructField("tags", _TEXTS), T.StructField("source", T.StringType()), T.StructField("confidence", T.DoubleType()),
     T.StructField("typed", T.StructType([T.StructField(f, T.DoubleType() if f in _NUMBERS else T.StringType()) for f in TYPED_FIELDS])),
     T.StructField("attributes", _MAP), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
)
RELATIONSHIP = T.StructType(
    [T.StructField("id", T.StringType(), False), T.StructField("source_id", T.StringType()), T.StructField("target_id", T.StringType()),
     T.StructField("rel_type", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("bidirectional", T.BooleanType()),
     T.StructField("description", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("attributes", _MAP),
     T.StructField("created_at", T.TimestampType())]
)


def latest_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per id: its record of the greatest record_no. Folded before the shuffle, so a hot id is one row a task."""
    e = table(spark, d, "entities").where("id IS NOT NULL")
    rest = [c for c in e.columns if c != "id"]
    return e.groupBy("id").agg(F.max_by(F.struct(*rest), "record_no").alias("r")).select("id", "r.*")


def distinct_relationships(spark: SparkSession, d: str) -> DataFrame:
    """The relationships without repeated rows."""
    r = table(spark, d, "relationships").where("id IS NOT NULL")
    return r.select("id", "source_id", "target_id", "rel_type", "weight", "bidirectional", "confidence").distinct()


def graph_of(spark: SparkSession, d: str) -> Graph:
    v = latest_entities(spark, d).select("id", "name", "entity_type", "canonical_name", "aliases", "description", "source", "confidence")
    return Graph(v, distinct_relationships(spark, d))


def export_snapshot(g: Graph, path: str) -> None:
    """entities, relationships and stats as JSON datasets under path."""
    g.vertices.write.mode("overwrite").json(f"{path}/entities")
    g.edges.write.mode("overwrite").json(f"{path}/relationships")
    n = g.vertices.groupBy("entity_type").count().withColumnRenamed("count", "entities")
    n.write.mode("overwrite").json(f"{path}/stats")


def import_snapshot(spark: SparkSession, path: str, vertex_schema: T.StructType, edge_schema: T.StructType) -> Graph:
    """The graph of a snapshot; fields that the schemas don't name are dropped."""
    return Graph(spark.read.schema(vertex_schema).json(f"{path}/entities"), spark.read.schema(edge_schema).json(f"{path}/relationships"))


def restore_snapshot(store, g: Graph) -> int:
    """Upsert the graph into the tables entities and relationships of a store, edges after entities; again changes nothing."""
    from .store import upsert

    if not store.version("entities"):
        store.write("entities", upsert(g.vertices.limit(0), g.vertices), "id")
    else:
        store.merge("entities", g.vertices, upsert, "id")
    if not store.version("relationships"):
        return store.write("relationships", upsert(g.edges.limit(0), g.edges), "id")
    return store.merge("relationships", g.edges, upsert, "id")


def dot_lines(g: Graph) -> DataFrame:
    """(line): the graph in DOT, without its first and last line."""
    esc = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), '"', r'\\\\"')
    nodes = g.vertices.select(F.concat(F.lit('  "'), esc(F.col("id")), F.lit('" [label="'), esc(F.col("name")), F.lit('"];')).alias("line"))
    links = g.edges.select(F.concat(F.lit('  "'), esc(F.col("source_id")), F.lit('" -> "'), esc(F.col("target_id")), F.lit('" [label="'), esc(F.col("rel_type")), F.lit('"];')).alias("line"))
    return nodes.unionByName(links)


def canned_search(docs: DataFrame, buckets: DataFrame, query: str, top: int = 5) -> DataFrame:
    """The documents of every bucket of which a key word occurs in the query, or of all if none does; best scores first."""
    q = query.lower()
    hit = buckets.where(F.exists(F.split(F.lower("bucket"), " "), lambda w: F.lit(q).contains(w)))
    own = docs.join(hit, "bucket", "left_semi") if not hit.isEmpty() else docs
    return own.orderBy(F.desc("score"), "url").limit(top)


def jdbc_table(spark: SparkSession, url: str, name: str, column: str | None = None, lower=None, upper=None, parts: int = 64) -> DataFrame:
    """A table of a database, read in ranges of `column` side by side."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("fetchsize", 10_000)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return r.load()
