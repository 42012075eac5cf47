"""Change capture: envelopes to triggers, and an ordered, idempotent projection of the latest change per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import Store

ROW = "id bigint, op string, entity_key string, payload string, status string, attempts int"
ENVELOPE = f"op string, before struct<id:bigint,status:string>, after struct<{ROW.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>"


def parse_envelopes(raw: DataFrame, value: str = "value") -> DataFrame:
    """(op, before, after) of the JSON texts; texts that are no envelope are passed over."""
    e = raw.select(F.from_json(F.col(value).cast("string"), ENVELOPE, {"mode": "PERMISSIVE"}).alias("e"))
    return e.where("e.op IS NOT NULL").select("e.*")


def triggers(envelopes: DataFrame) -> DataFrame:
    """(id): rows that became pending: created so, or updated from another status; a missing `before` counts as another."""
    pending = F.col("after.status") == "pending"
    became = (F.col("op") == "c") | ((F.col("op") == "u") & ~F.col("before.status").eqNullSafe(F.lit("pending")))
    return envelopes.where(pending & became & F.col("after.id").isNotNull()).select(F.col("after.id").alias("id"))


def latest_changes(changes: DataFrame, key: str = "entity_key", order: str = "id") -> DataFrame:
    """The last change of each key, by one partial aggregate; null keys are left out."""
    rest = [c for c in changes.columns if c != key]
    return changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def apply_changes(state: DataFrame, changes: DataFrame, key: str = "entity_key", order: str = "id") -> DataFrame:
    """state (key, payload, order) after the changes (key, op, payload, order): whole batches may come again or out of order.

    Deletes stay as rows without payload, so that an older change that comes late does not revive them."""
    new = latest_changes(changes, key, order).select(key, F.when(~F.col("op").startswith("delete"), F.col("payload")).alias("payload"), order)
    both = state.select(key, "payload", order).unionByName(new)
    return both.groupBy(key).agg(F.max_by("payload", order).alias("payload"), F.max(order).alias(order))


def project_stream(spark: SparkSession, source: DataFrame, store: Store, table: str, checkpoint_dir: str, key: str = "entity_key", order: str = "id"):
    """Runs all that the streaming source holds into the table of the store and returns the ended query.

    Each micro-batch is one commit that rewrites the buckets of its keys; a repeated batch changes nothing. Use again to go on from the checkpoint."""
    kinds = {f.name: f.dataType for f in source.schema.fields}
    empty = T.StructType([T.StructField(key, kinds[key]), T.StructField("payload", T.StringType()), T.StructField(order, kinds[order])])

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            fold = lambda old, new: apply_changes(old, new, key, order)
            changes = batch.where(F.col(key).isNotNull())
            if store.version(table) == 0:
                store.write(table, fold(store.read(table, empty), changes), key)
            else:
                store.merge(table, changes, fold, key)

    q = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def kafka_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """(value) of a topic, from the earliest record on; offsets are kept by the query's checkpoint."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()


OUTBOX_OUT = "id long, status string, attempts int, last_error string"
OUTBOX_STATE = "status string, attempts int, last_error string"


def outbox_states(events: DataFrame, lock_minutes: int = 5) -> DataFrame:
    """(id, status, attempts, last_error) after each micro-batch of events (id, event, error) of outbox rows.

    pending -claim-> processing -done-> done, -fail-> pending with one attempt more. A claim that is not ended in
    `lock_minutes` of processing time is released. Other events change nothing."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, attempts, error = state.get if state.exists else ("pending", 0, None)
        if state.hasTimedOut:
            status = "pending" if status == "processing" else status
        else:
            for pdf in batches:
                for event, err in zip(pdf["event"], pdf["error"]):
                    if event == "claim" and status == "pending":
                        status = "processing"
                    elif event == "done" and status == "processing":
                        status = "done"
                    elif event == "fail" and status == "processing":
                        status, attempts, error = "pending", attempts + 1, err
        state.update((status, attempts, error))
        if status == "processing":
            state.setTimeoutDuration(lock_minutes * 60_000)
        yield pd.DataFrame([(key[0], status, attempts, error)], columns=["id", "status", "attempts", "last_error"])

    return events.groupBy("id").applyInPandasWithState(run, OUTBOX_OUT, OUTBOX_STATE, "update", "ProcessingTimeTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of event-time windows; works on streams, where rows later than `late` are dropped."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")
