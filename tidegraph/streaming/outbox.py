"""The outbox: rows of what was changed, written in the commit of the change, and their projection in order.

Rows are (id, op, entity_key, payload, status, attempts, last_error, locked_at). Ids rise with the commits.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store, number_rows
from .cdc import apply_changes

#: What an outbox row may ask for.
OPS = ("upsert_entity", "upsert_relationship", "delete_entity", "delete_relationship")
SCHEMA = "id long, op string, entity_key string, payload string, status string, attempts int, last_error string, locked_at timestamp"
LOCK = timedelta(minutes=5)


def outbox_rows(changed: DataFrame, op: str, key: str = "id") -> DataFrame:
    """(op, entity_key, payload, ...) of rows that were changed, pending; the payload is the row as JSON."""
    return changed.select(
        F.lit(op).alias("op"), F.col(key).cast("string").alias("entity_key"), F.to_json(F.struct("*")).alias("payload"), F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("locked_at"),
    )


def change(store: Store, table: str, rows: DataFrame, op: str, fold: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id", outbox: str = "outbox") -> int:
    """Merge rows into a table and add their outbox rows, in one commit: both are there or neither."""
    base = store.last()
    at = (store.read(outbox).agg(F.max("id")).head()[0] or 0) if store.version(outbox) else 0
    told = number_rows(outbox_rows(rows, op, key), "id", at, ["entity_key", "payload"])
    told = told.select(*[f.split()[0] for f in SCHEMA.split(", ")])
    how = "merge" if store.version(table) else "write"
    first = store.staged(table, rows, key, how, fold, base)
    second = store.staged(outbox, told, "id", "append", base=base)
    return store.commit({table: first, outbox: second}, base)


def pending(outbox: DataFrame, limit: int = 500) -> DataFrame:
    """The oldest pending rows, first in first out."""
    return outbox.where("status = 'pending'").orderBy("id").limit(limit)


def claimed(outbox: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """outbox in which the pending rows of ids are being worked on."""
    mine = ids.select("id").distinct().withColumn("__c", F.lit(True))
    j = outbox.join(mine, "id", "left")
    hit = F.col("__c") & (F.col("status") == "pending")
    return j.withColumn("locked_at", F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("locked_at"))).withColumn("status", F.when(hit, "processing").otherwise(F.col("status"))).drop("__c")


def released(outbox: DataFrame, now: datetime, lock: timedelta = LOCK) -> DataFrame:
    """outbox in which claims older than `lock` are pending again."""
    stale = (F.col("status") == "processing") & (F.coalesce("locked_at", F.lit(datetime(1970, 1, 1, tzinfo=UTC)).cast("timestamp")) < F.lit(now - lock).cast("timestamp"))
    return outbox.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("locked_at", F.when(stale, F.lit(None)).otherwise(F.col("locked_at")))


def fault(row_op="op", row_key="entity_key", payload="payload"):
    """What is wrong with a row, or null."""
    upsert = F.col(row_op).startswith("upsert")
    return F.when(~F.coalesce(F.col(row_op).isin(*OPS), F.lit(False)), F.concat(F.lit("Unknown outbox op: "), F.coalesce(F.col(row_op), F.lit("null")))).when(
        F.col(row_key).isNull(), "no key").when(upsert & F.try_parse_json(payload).isNull(), "no payload")


def drained(outbox: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(rows to apply, outbox after it): the oldest pending rows up to the first that can't be applied.

    That one stays pending with an attempt more and its error; those behind it wait."""
    batch = pending(outbox, limit).withColumn("__f", fault())
    bad = batch.where("__f IS NOT NULL").agg(F.min("id").alias("__bad"))  # one row
    ready = batch.crossJoin(F.broadcast(bad)).where("__bad IS NULL OR id < __bad").drop("__f", "__bad")
    done = ready.select("id", F.lit("done").alias("__s"), F.lit(None).cast("string").alias("__e"))
    stopped = batch.join(F.broadcast(bad), F.col("id") == F.col("__bad")).select("id", F.lit("pending").alias("__s"), F.col("__f").alias("__e"))
    after = outbox.join(done.unionByName(stopped), "id", "left")
    after = after.withColumn("status", F.coalesce("__s", "status")).withColumn("attempts", F.when(F.col("__e").isNotNull(), F.col("attempts") + 1).otherwise(F.col("attempts")))
    return ready, after.withColumn("last_error", F.coalesce("__e", "last_error")).drop("__s", "__e")


def drain(store: Store, target: str, limit: int = 500, outbox: str = "outbox", now: datetime | None = None) -> int:
    """Apply one batch of the outbox to the projection `target` (entity_key, payload, id) and mark it, in one commit; returns how many rows.

    Raises at a row that can't be applied, after what came before it is applied and its error is noted."""
    from ..session import checkpoint

    if not store.version(outbox):
        return 0
    base = store.last()
    rows = released(store.read(outbox), now or datetime.now(UTC))
    ready, after = drained(rows, limit)
    ready, after = checkpoint(ready), checkpoint(after)
    n = ready.count()
    failed = after.where("status = 'pending' AND last_error IS NOT NULL").orderBy("id").select("id", "last_error").head()
    new = {outbox: store.staged(outbox, after, "id", base=base)}
    if n:
        fold = lambda old, x: apply_changes(old, x)
        if store.version(target):
            new[target] = store.staged(target, ready, "entity_key", "merge", fold, base)
        else:
            empty = store.spark.createDataFrame([], "entity_key string, payload string, id long")
            new[target] = store.staged(target, fold(empty, ready), "entity_key", base=base)
    store.commit(new, base)
    if failed is not None and n < limit:
        first = pending(after, 1).select("id").head()
        if first is not None and first[0] == failed[0]:
            raise ValueError(f"outbox row {failed[0]}: {failed[1]}")
    return n


def reconcile(store: Store, target: str, batch: int = 200, outbox: str = "outbox") -> int:
    """Drain until nothing is pending; returns how many rows. Stops with the error of the first row that can't be applied."""
    total = 0
    while n := drain(store, target, batch, outbox):
        total += n
    return total


class Barrier:
    """Reads of a projection that see every write before them: what is pending is drained first.

    If that fails the source table is read instead, and `degraded` says so, until the next write."""

    def __init__(self, store: Store, source: str, target: str, outbox: str = "outbox"):
        self.store, self.source, self.target, self.outbox = store, source, target, outbox
        self.seen, self.degraded = -1, False

    def read(self) -> DataFrame:
        if self.seen != self.store.last():
            try:
                reconcile(self.store, self.target, outbox=self.outbox)
                self.degraded = False
            except ValueError:
                self.degraded = True
            self.seen = self.store.last()
        return self.store.read(self.source if self.degraded or not self.store.version(self.target) else self.target)
