"""Harmonic packing of items into containers of fixed capacity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread

CLASSES = 16  # sizes above capacity/16 form classes of reciprocal capacity; smaller ones are filled in
BUCKET = 40_000  # pieces that one worker packs by itself
RUN = 1_000  # equal rows that are numbered together


def pack(sizes: np.ndarray, capacity: int, classes: int = CLASSES) -> np.ndarray:
    """Container number of each size; sizes are 0..capacity and come in the order that breaks ties.

    Class k holds sizes in (capacity/(k+1), capacity/k]; a container that is opened for class k takes
    k items of it. Before a class opens containers its items go where the least room that still
    holds them is left in containers of larger classes. Sizes up to capacity/classes only fill room
    and then follow one another. Size 0 takes room nowhere and goes to the first container."""
    n = len(sizes)
    where = np.zeros(n, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_mask, made = 0, 0

    def put(box: int, room: int) -> None:
        nonlocal open_mask
        if room > 0:
            free[room].append(box)
            open_mask |= 1 << room

    def take(size: int) -> tuple[int, int]:
        nonlocal open_mask
        rest = open_mask >> size
        if not rest:
            return -1, 0
        room = size + (rest & -rest).bit_length() - 1
        box = free[room].pop()
        if not free[room]:
            open_mask ^= 1 << room
        return box, room

    i = 0
    while i < n:
        size = int(sizes[order[i]])
        if size == 0:
            break
        k = min(capacity // size, classes)
        j = i
        while j < n and sizes[order[j]] > 0 and min(capacity // int(sizes[order[j]]), classes) == k:
            j += 1
        left = []
        for at in order[i:j]:
            box, room = take(int(sizes[at]))
            if box < 0:
                left.append(at)
            else:
                where[at] = box
                put(box, room - int(sizes[at]))
        at = 0
        while at < len(left):
            room, held = capacity, 0
            while at < len(left) and sizes[left[at]] <= room and (held < k or k == classes):
                where[left[at]] = made
                room -= int(sizes[left[at]])
                held += 1
                at += 1
            put(made, room)
            made += 1
        i = j
    return where


def pack_documents(docs: DataFrame, key: str, tokens: str, capacity: int = 2048, classes: int = CLASSES, bucket: int = BUCKET) -> DataFrame:
    """(key, piece, first_token, n_tokens, container): every document, or every piece of one longer than a container.

    Pieces are spread over workers by a hash of key, size, piece and, among equal rows, their number, so copies of a key
    or a size never meet in one task and the same table is packed alike however its files are split; each worker packs
    `bucket` pieces on average by itself. Null and negative counts are 0; a document without tokens is one piece of 0
    tokens in the first container of its worker. Repeated and null keys are packed row by row. Other columns are left out."""
    spark = docs.sparkSession
    size = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long")
    sized = checkpoint(docs.select(F.col(key).alias("k"), size.alias("n")))
    pieces = F.greatest(F.ceil(F.col("n") / capacity).cast("int"), F.lit(1))
    rows = sized.agg(F.sum(pieces.cast("long"))).head()[0] or 0
    many = max(1, -(-rows // bucket))
    # equal rows are counted, not collected, and numbered in runs, which are spread before they are unfolded
    runs = sized.groupBy("k", "n").agg(F.count("*").alias("c")).select(
        "k", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / RUN))).alias("q"), "c"
    ).repartition(spread(spark, rows, bucket), "k", "n", "q")
    equal = runs.select("k", "n", F.explode(F.sequence(F.col("q") * RUN, F.least(F.col("c"), (F.col("q") + 1) * RUN) - 1)).alias("no"))
    pieces = (
        equal.select("k", "n", "no", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
        .select("k", "n", "no", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).cast("int").alias("m"))
        .withColumn("b", F.pmod(F.xxhash64("k", "n", "piece", "no"), F.lit(many)).cast("int"))
        .select("k", "piece", "m", "b")
    )
    kind = docs.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["m", "k", "piece"], ascending=[False, True, True], kind="stable")
        box = pack(group["m"].to_numpy(dtype=np.int64), capacity, classes)
        return pd.DataFrame(
            {"k": group["k"], "piece": group["piece"], "m": group["m"], "container": group["b"].astype("int64") * 2**32 + box}
        )

    packed = (
        pieces.repartition(min(many, spread(spark, rows, bucket)), "b").groupBy("b").applyInPandas(run, f"k {kind}, piece int, m int, container long")
    )
    return packed.select(
        F.col("k").alias(key),
        "piece",
        (F.col("piece").cast("long") * capacity).alias("first_token"),
        F.col("m").alias("n_tokens"),
        "container",
    )


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: pieces, tokens, containers, least number possible, share of room used."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    return per.agg(
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.count("*").alias("containers"),
        F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity).alias("least_containers"),
        F.round(F.coalesce(F.sum("used") / (F.count("*") * capacity), F.lit(0.0)), 4).alias("filled"),
        F.coalesce(F.max("used"), F.lit(0)).alias("most_used"),
    )
