"""Session helpers: local sessions for tests/bench and a shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Rows of one Arrow batch handed to a Python worker; texts can be long, so batches stay short.
BATCH_ROWS = 500
#: Bytes of one batch where rows may be large (a larger row comes alone).
BATCH_BYTES = 16 << 20


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "pagemill") -> SparkSession:
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    b = (
        SparkSession.builder.master(master or "local[8]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's spark.checkpoint.dir, or the one set on the context. On
    one machine without either (tests) a new folder below /tmp; on a cluster that is an error, since
    executors could not read each other's files."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="pagemill-ckpt-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers by the rows of a batch; a lower bound stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the memory of Python workers by the rows and the bytes of a batch."""
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
