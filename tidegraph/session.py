"""Session helpers: table loading, checkpoints on shared storage, sizes."""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Largest side, in estimated bytes, that an operator may hint as a broadcast.
BROADCAST_LIMIT = 8 << 20


def build_session(app: str = "tidegraph", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir.

    Only where a session has none (local tests) a local folder is set."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not conf and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(conf or os.path.join(tempfile.gettempdir(), "tidegraph-checkpoints"))
        held = sc._jsc.sc().getCheckpointDir()
    return conf or held.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there: the lineage ends, executors may be lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the files of shuffles that no plan refers to any more be removed now, before a step that writes much.

    The driver's own references go first, which the gateway passes on about once a second."""
    import gc
    import time

    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; used to check a side before a broadcast hint."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(spark: SparkSession, rows: int, per_part: int) -> int:
    """Number of partitions for `rows` rows at `per_part` a partition; at least the parallelism."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / per_part))
