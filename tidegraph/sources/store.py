"""A versioned store of Parquet tables: upserts, deletes with cascade, appends, and the outbox of changes.

A commit is one small file that names the data folders of every table, bucket by bucket. It is written beside its final
name and then renamed to the next number, so readers see a commit whole or not at all, and a crash at any moment leaves
the last one. An append adds folders and rewrites nothing; a merge rewrites the buckets of the keys it touches. One commit
may change several tables, as a write and its outbox rows do. Writers are one at a time; a second one fails at the rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import normalize_surface

BUCKETS = 64  # parts of a keyed table; a merge rewrites those that hold its keys


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- commits --------------------------------------------------------------
    def _commits(self) -> str:
        return f"{self.root}/_commits"

    def last(self) -> int:
        """The number of the last commit; 0 before the first."""
        p = self._path(self._commits())
        if not self._fs.exists(p):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(p)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _state(self, number: int | None = None) -> dict:
        n = self.last() if number is None else number
        if not n:
            return {}
        stream = self._fs.open(self._path(f"{self._commits()}/{n:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, changed: dict[str, dict], base: int) -> int:
        """Publish the new states of some tables over commit `base`; raises if another writer was faster."""
        state = {**self._state(base), **changed}
        tmp = self._path(f"{self._commits()}/_{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final = self._path(f"{self._commits()}/{base + 1:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(tmp, final):
            self._fs.delete(tmp, False)
            raise RuntimeError(f"commit {base + 1} was made by another writer")
        return base + 1

    # -- tables ---------------------------------------------------------------
    def version(self, name: str) -> int:
        """How often the table was changed; 0 if it is not there."""
        return self._state().get(name, {}).get("version", 0)

    def read(self, name: str, schema: T.StructType | None = None, at: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table as of the last commit, or of commit `at`; only some buckets of it if asked."""
        t = self._state(at).get(name)
        if t is None:
            if schema is None:
                raise LookupError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        kept = [b for b in t["parts"] if buckets is None or int(b) in buckets]
        paths = [f"{self.root}/{name}/{folder}/__b={b}" for b in kept for folder in t["parts"][b]]
        own = T.StructType.fromJson(t["schema"])
        return self.spark.read.schema(own).parquet(*paths) if paths else self.spark.createDataFrame([], own)

    def _bucket(self, key: str | None):
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int") if key else F.lit(0)

    def _land(self, name: str, df: DataFrame, key: str | None) -> tuple[str, list[str]]:
        """A new folder with the rows by bucket, and its buckets."""
        folder = f"d{uuid.uuid4().hex}"
        df.withColumn("__b", self._bucket(key)).write.partitionBy("__b").parquet(f"{self.root}/{name}/{folder}")
        dirs = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{name}/{folder}"))]
        return folder, [d[4:] for d in dirs if d.startswith("__b=")]

    def staged(self, name: str, df: DataFrame, key: str | None = None, how: str = "write", fold: Callable[[DataFrame, DataFrame], DataFrame] | None = None, base: int | None = None) -> dict:
        """The state of a table after a change that is landed but not committed. how: write, append or merge (fold(old, new))."""
        old = self._state(base).get(name)
        parts = {b: list(f) for b, f in old["parts"].items()} if old else {}
        key = key or (old or {}).get("key")
        schema = df.schema
        if how == "write" or old is None and how == "append":
            folder, mine = self._land(name, df, key)
            parts = {b: [folder] for b in mine}
        elif how == "append":
            schema = T.StructType.fromJson(old["schema"])
            given = [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
            folder, mine = self._land(name, df.select(*given, *[c for c in df.columns if c not in schema.names]), key)
            schema = T.StructType([*schema, *[f for f in df.schema if f.name not in schema.names]])
            for b in mine:
                parts.setdefault(b, []).append(folder)
        else:
            touched = [r[0] for r in df.select(self._bucket(key).alias("b")).distinct().collect()]  # at most `buckets`
            held = self.read(name, fold(df.limit(0), df.limit(0)).schema if old is None else None, base, touched)
            merged = fold(held, df)
            folder, mine = self._land(name, merged, key)
            schema = merged.schema
            for b in touched:
                parts.pop(str(b), None)
            parts.update({b: [folder] for b in mine})
        plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        return {"version": (old or {}).get("version", 0) + 1, "schema": plain.jsonValue(), "key": key, "parts": parts}

    def write(self, name: str, df: DataFrame, key: str | None = None) -> int:
        base = self.last()
        state = self.staged(name, df, key, base=base)
        self.commit({name: state}, base)
        return state["version"]

    def append(self, name: str, rows: DataFrame, serial: str | None = None, order: list[str] | None = None, key: str | None = None) -> int:
        """Rows after those there are. serial: a column numbered on from its greatest, in the given order."""
        base = self.last()
        if serial:
            at = (self.read(name).agg(F.max(serial)).head()[0] or 0) if self.version(name) else 0
            rows = number_rows(rows, serial, at, order or rows.columns)
        state = self.staged(name, rows, key, "append", base=base)
        self.commit({name: state}, base)
        return state["version"]

    def merge(self, name: str, rows: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], key: str) -> int:
        """fold(old, rows) over the buckets that hold keys of rows; the others stay as they are."""
        base = self.last()
        state = self.staged(name, rows, key, "merge", fold, base)
        self.commit({name: state}, base)
        return state["version"]

    def compact(self, name: str) -> int:
        """The same rows in one folder a bucket, after many appends."""
        return self.write(name, self.read(name), self._state()[name]["key"])


def number_rows(rows: DataFrame, serial: str, start: int, order: list[str]) -> DataFrame:
    """rows with consecutive numbers after `start` in the given order, counted range by range and not in one task."""
    part = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    from ..session import checkpoint

    part = checkpoint(part)
    sizes = part.groupBy("__p").count()  # one row a partition
    base = sizes.withColumn("__b", F.sum("count").over(Window.orderBy("__p")) - F.col("count")).select("__p", "__b")
    w = Window.partitionBy("__p").orderBy(*order)
    return part.join(F.broadcast(base), "__p").withColumn(serial, (F.row_number().over(w) + F.col("__b") + start).cast("long")).drop("__p", "__b")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", keep: tuple[str, ...] = ("created_at",), order: str | None = None) -> DataFrame:
    """old with new's rows in place of those of the same key; `keep` columns stay as they were first.

    Of several new rows of a key the one of the greatest `order` counts (any one without it). Null keys are
    refused by leaving them out. Idempotent."""
    new = new.where(F.col(key).isNotNull())
    rest = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg((F.max_by(F.struct(*rest), order) if order else F.first(F.struct(*rest))).alias("__n"))
    cols = [c for c in old.columns if c != key]
    j = old.select(key, F.struct(*cols).alias("__o")).join(one, key, "full_outer")
    has_new = F.col("__n").isNotNull()
    value = lambda c: (
        F.when(has_new, F.coalesce(F.col("__o")[c], F.col("__n")[c]) if c in keep else F.col("__n")[c]).otherwise(F.col("__o")[c])
        if c in rest
        else F.col("__o")[c]
    ).alias(c)
    return j.select(key, *[value(c) for c in cols])


def only_linked(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which both ends are entities and differ; others are refused at the write."""
    ids = entities.select("id")
    e = edges.where(F.col("source_id") != F.col("target_id"))
    return e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def cascade_delete(entities: DataFrame, edges: DataFrame, ids: DataFrame, aliases: DataFrame | None = None, mentions: DataFrame | None = None):
    """(entities, edges, aliases, mentions) without the ids: their edges and aliases go, mentions resolved to them are open again."""
    gone = ids.select("id").distinct()
    e = entities.join(gone, "id", "left_anti")
    r = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    a = aliases.join(gone.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti") if aliases is not None else None
    m = None
    if mentions is not None:
        hit = gone.select(F.col("id").alias("__g"))
        m = mentions.join(hit, F.col("resolved_entity_id") == F.col("__g"), "left").withColumn("resolved_entity_id", F.when(F.col("__g").isNull(), F.col("resolved_entity_id"))).drop("__g")
    return e, r, a, m


def upsert_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_id, normalized_alias, alias, confidence, verified): the greatest confidence, verified if ever, the first spelling by seq."""
    both = old.unionByName(new.withColumn("normalized_alias", normalize_surface(F.col("alias"))), allowMissingColumns=True)
    both = both.where("normalized_alias != '' AND entity_id IS NOT NULL")
    return both.groupBy("entity_id", "normalized_alias").agg(
        F.min_by("alias", F.struct(F.coalesce("seq", F.lit(-1)), "alias")).alias("alias"), F.max(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("confidence"), F.bool_or("verified").alias("verified"), F.min("seq").alias("seq")
    )


def add_missing_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["entity_id", "normalized_alias"]
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def alias_arrays(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def resolve_reviews(reviews: DataFrame, mentions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews, mentions, aliases to add) after decisions (review_id, status, entity_id, notes).

    A mention becomes LINKED if an entity is named, else it takes the status in capitals; its text becomes a verified alias."""
    d = decisions.select("review_id", F.col("status").alias("__s"), F.col("entity_id").alias("__e"), F.col("notes").alias("__n"))
    r = reviews.join(d, "review_id", "left")
    done = r.withColumn("status", F.coalesce("__s", "status")).withColumn("notes", F.coalesce("__n", "notes"))
    hit = done.where("__s IS NOT NULL").select("mention_id", "__s", "__e")
    m = mentions.join(hit, "mention_id", "left")
    m = m.withColumn("status", F.when(F.col("__e").isNotNull(), "LINKED").when(F.col("__s").isNotNull(), F.upper("__s")).otherwise(F.col("status")))
    m = m.withColumn("resolved_entity_id", F.coalesce("__e", "resolved_entity_id"))
    add = m.where("__e IS NOT NULL").select(F.col("__e").alias("entity_id"), F.col("text").alias("alias"), F.lit(1.0).alias("confidence"), F.lit(True).alias("verified"))
    return done.drop("__s", "__e", "__n"), m.drop("__s", "__e"), add


def changed_embeddings(entities: DataFrame, hashes: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """embed(rows) of the entities whose text hash is new; embed maps (id, text, content_hash) to (id, embedding, content_hash)."""
    from ..functions.text import content_hash, content_text

    parts = [F.col("name"), F.col("canonical_name"), F.col("description")]
    now = entities.select("id", content_text(*parts).alias("text"), content_hash(*parts).alias("content_hash"))
    return embed(now.join(hashes.select("id", "content_hash"), ["id", "content_hash"], "left_anti"))
