"""Entities and relationships as flat records and back, and values as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import TYPED_FIELDS

#: What a record folds into its attributes besides the fields of the type.
IDENTITY = ("canonical_name", "aliases", "lang", "external_ids", "embedding")


def _folded(entities: DataFrame) -> Column:
    """The identity and type fields that say something, as texts; lists and maps as JSON."""
    kinds = {f.name: f.dataType for f in entities.schema.fields}
    parts = []
    for name in IDENTITY:
        if name not in kinds:
            continue
        simple = kinds[name].simpleString() == "string"
        text = F.col(name) if simple else F.to_json(name)
        some = F.col(name) != "" if simple else F.size(name) > 0
        parts.append(F.struct(F.lit(name).alias("k"), F.when(some, text).alias("v")))
    if "typed" in kinds:
        parts += [F.struct(F.lit(f).alias("k"), F.col(f"typed.{f}").cast("string").alias("v")) for f in TYPED_FIELDS]
    return F.map_from_entries(F.filter(F.array(*parts), lambda x: x["v"].isNotNull()))


def to_records(entities: DataFrame) -> DataFrame:
    """(id, entity_type, name, description, tags, source, confidence, attributes, created_at): all other fields are folded into attributes.

    A field of the type wins over an attribute of its name. Nulls, empty texts, lists and maps are left out."""
    own = F.coalesce("attributes", F.expr("cast(map() as map<string,string>)"))
    rest = F.map_filter(own, lambda k, _: ~k.isin(*IDENTITY, *TYPED_FIELDS))
    return entities.select(
        "id", "entity_type", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("source", F.lit("manual")).alias("source"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.map_concat(rest, _folded(entities)).alias("attributes"), "created_at",
    )


def from_records(records: DataFrame, template: DataFrame) -> DataFrame:
    """Entities of the columns of `template` that records can hold; attributes that no field names stay attributes."""
    kinds = {f.name: f.dataType for f in template.schema.fields}
    a = F.col("attributes")
    out = ["id", "entity_type", "name", "description", "tags", "source", "confidence", "created_at"]
    for name in IDENTITY:
        if name in kinds:
            kind = kinds[name].simpleString()
            out.append((a[name] if kind == "string" else F.from_json(a[name], kind)).alias(name))
    if "typed" in kinds:
        out.append(F.struct(*[a[f.name].cast(f.dataType).alias(f.name) for f in kinds["typed"].fields]).alias("typed"))
    return records.select(*out, F.map_filter(a, lambda k, _: ~k.isin(*IDENTITY, *TYPED_FIELDS)).alias("attributes"))


def to_relationship_records(edges: DataFrame) -> DataFrame:
    """edges with relationship_type for rel_type and times as ISO texts."""
    out = edges.withColumnRenamed("rel_type", "relationship_type")
    return out.withColumn("created_at", iso(F.col("created_at"))) if "created_at" in out.columns else out


def from_relationship_records(records: DataFrame) -> DataFrame:
    out = records.withColumnRenamed("relationship_type", "rel_type")
    return out.withColumn("created_at", F.to_timestamp("created_at")) if "created_at" in out.columns else out


def iso(time: Column) -> Column:
    """ISO-8601 with microseconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def properties(records: DataFrame) -> DataFrame:
    """(id, property, value): what a node of a graph store holds of each record; attributes side by side with the fields, nothing null."""
    fields = [F.struct(F.lit(c).alias("property"), (F.array_join(c, ",") if c == "tags" else F.col(c).cast("string")).alias("value")) for c in records.columns if c not in ("id", "attributes")]
    more = F.transform(F.map_entries("attributes"), lambda x: F.struct(x["key"].alias("property"), x["value"].alias("value")))
    return records.select("id", F.inline(F.filter(F.concat(F.array(*fields), more), lambda x: x["value"].isNotNull() & (x["value"] != ""))))


def serialised(value: Column) -> Column:
    """JSON of a value; nulls are kept as null."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def serialised_paths(paths: DataFrame, path: str = "named") -> DataFrame:
    """paths with `json`: {"nodes": [{"id", "name"}, ...]} of an array of (id, name)."""
    return paths.withColumn("json", F.to_json(F.struct(F.transform(path, lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("nodes")), {"ignoreNullFields": "false"}))
