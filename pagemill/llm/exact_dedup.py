"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a table bucketed and sorted by the SHA-256 of the text; it names the batch that brought each
digest. A batch is reduced to its distinct digests, the ones the index lacks are found by a sort-merge anti-join and
appended; a digest that the same batch brought before counts as its own, so a batch that is run again after
a failure has the same result and appends nothing twice. Rows of
equal text then look their digest up; digests that hold over a thousandth of the batch (so at most a
thousand of them) are looked up by broadcast, because one task could not take all their rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

#: Texts with more than 1 / HOT_SHARE of a batch's rows are joined by broadcast; there are fewer than HOT_SHARE.
HOT_SHARE = 1000


def digest(text: str = "text"):
    """SHA-256 of the UTF-8 text as binary; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def create_index(spark: SparkSession, name: str, buckets: int) -> str:
    """An empty index table: digest, keep_id (the row that stays), batch (that brought it), bucketed and sorted by digest."""
    spark.createDataFrame([], "digest binary, keep_id long, batch string").write.bucketBy(buckets, "digest").sortBy("digest").format("parquet").saveAsTable(name)
    return name


def deduplicate(docs: DataFrame, index: str, buckets: int, batch: str | None = None) -> DataFrame:
    """Marks the rows of ``docs`` that stay, and appends the new digests to the index.

    Of equal texts that the index lacks, the row with the largest doc_id stays (of rows that repeat
    both doc_id and text, one); texts the index holds are dropped in favour of the row it names.
    Null text counts as empty; null doc_ids rank lowest; an empty table gives no rows; other columns
    are ignored. ``batch`` names these rows: running them again under the same name gives the same
    result (without a name every call is a batch of its own). Returns doc_id, keep_id, group_size (rows of this batch with the text), kept,
    text_sha256.
    """
    spark = docs.sparkSession
    rows = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), F.monotonically_increasing_id().alias("uid")))
    groups = checkpointed(rows.groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    fresh = groups.join(spark.table(index).hint("merge"), "digest", "left_anti").select("digest", F.col("top.doc_id").alias("keep_id"))
    fresh = checkpointed(fresh)
    batch = batch or uuid.uuid4().hex
    fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(buckets, "digest").write.mode("append").bucketBy(buckets, "digest").sortBy("digest").format("parquet").saveAsTable(index)
    known = spark.table(index).select("digest", F.col("keep_id").alias("held_id"), (F.col("batch") == batch).alias("own"))
    found = checkpointed(
        groups.join(known, "digest")
        .select("digest", F.col("held_id").alias("keep_id"), F.when(F.col("own"), F.col("top.uid")).alias("keep_uid"), F.col("n").alias("group_size"))
    )
    hot = found.where(F.col("group_size") * HOT_SHARE > total).select("digest", *(F.col(c).alias(f"hot_{c}") for c in ("keep_id", "keep_uid", "group_size")))
    # A hot row's own join key is a hash of its place, which no text has: it spreads and finds nothing.
    looked = rows.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("hot_group_size").isNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.col("uid").cast("string").cast("binary")))))
    out = looked.join(found.select(F.col("digest").alias("key"), "keep_id", "keep_uid", "group_size"), "key", "left")
    pick = lambda c: F.coalesce(f"hot_{c}", c)
    return out.select(
        "doc_id", pick("keep_id").alias("keep_id"), pick("group_size").alias("group_size"),
        F.coalesce(F.col("uid") == pick("keep_uid"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_index(spark: SparkSession) -> tuple[str, int]:
    """A fresh index in the warehouse, with as many buckets as the session shuffles into."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return create_index(spark, f"pagemill_digests_{uuid.uuid4().hex}", buckets), buckets


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all columns."""
    index, buckets = new_index(docs.sparkSession)
    kept = deduplicate(docs, index, buckets).where("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest"))
    marked = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), digest().alias("_text"))
    joined = marked.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_digest")), "left_semi")
    return joined.dropDuplicates(["_doc", "_text"]).select("_row.*")
