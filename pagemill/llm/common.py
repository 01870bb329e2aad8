"""Helpers shared by the training-data operators: tables, shared storage, distributed ranks."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.session import bounded_batches, ensure_checkpoint_dir, small_batches  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, with the lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """DataFrames made inside drop their shuffle files when an action on them ends.

    For chains of checkpointed steps: nothing reads a step's shuffles after its checkpoint, so a chain
    of any length holds the files of one step. A DataFrame used again just shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (the folds of held-out rows)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)).cast("int")


def grouped_rank(df: DataFrame, key: str, uid: str, counts: dict[int, int], rows: int = 128) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each value of the integer column ``key``.

    A key may hold most of the rows, so each one is dealt over buckets of about ``rows`` rows; a
    row's rank is its place in its bucket after the rows of earlier buckets. Bucket totals are
    summed over runs of 1,024 buckets, then over the runs, so that no task sorts a whole key.
    ``counts`` has the rows of each key; ``uid`` must be unique and fixed (e.g. checkpointed).
    """
    spark = df.sparkSession
    sizes = spark.createDataFrame([(k, max(1, -(-n // rows))) for k, n in sorted(counts.items())], f"`{key}` int, _buckets long")
    dealt = df.join(F.broadcast(sizes), key).withColumn("_bucket", F.pmod(F.xxhash64(uid), "_buckets"))
    totals = dealt.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", F.floor(F.col("_bucket") / 1024))
    runs = (
        totals.groupBy(key, "_run").agg(F.sum("_n").alias("_run_n"))
        .select(key, "_run", F.coalesce(F.sum("_run_n").over(Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_run_at"))
    )
    offsets = (
        totals.withColumn("_at", F.coalesce(F.sum("_n").over(Window.partitionBy(key, "_run").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(runs, [key, "_run"])
        .select(key, "_bucket", (F.col("_at") + F.col("_run_at")).alias("_offset"))
    )
    place = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(uid)) - 1
    return (
        dealt.withColumn("_place", place).join(offsets, [key, "_bucket"])
        .withColumn("rank", F.col("_offset") + F.col("_place"))
        .drop("_bucket", "_buckets", "_place", "_offset")
    )
