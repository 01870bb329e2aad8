"""Request operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import js_trim
from pagemill.options import EVENT_PAGE_RENDERED, EVENT_PAGE_SCRAPED, MSG_NO_URLS

# A1: the batch request document, one JSON object per run.
INPUT_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("startUrls", T.ArrayType(T.StringType())),
    T.StructField("includeLinks", T.BooleanType()),
    T.StructField("renderJs", T.BooleanType()),
    T.StructField("renderWaitMs", T.LongType()),
    T.StructField("eventLimit", T.LongType()),
])


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A1: run inputs from JSON lines with an explicit schema (never inferred)."""
    return spark.read.schema(INPUT_SCHEMA).json(path)


def union_inputs(inputs: DataFrame) -> DataFrame:
    """``url`` first, then ``startUrls`` in order -> (run_id, ord, raw_url).

    Non-string entries arrive as NULL and become '' (B8 then drops them)."""
    arr = F.concat(
        F.when(F.col("url").isNotNull(), F.array(F.col("url"))).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.col("startUrls"), F.array().cast("array<string>")),
    )
    return inputs.select("run_id", F.posexplode(arr).alias("ord", "raw_url")).select(
        "run_id", F.col("ord").cast("bigint").alias("ord"), F.coalesce("raw_url", F.lit("")).alias("raw_url"))


def run_options(inputs: DataFrame) -> DataFrame:
    """Per-run options with defaults applied by ``coalesce`` (null only, not false/0)."""
    return inputs.select(
        "run_id",
        F.col("eventLimit").alias("event_limit"),
        F.coalesce("includeLinks", F.lit(True)).alias("include_links"),
        F.coalesce("renderJs", F.lit(False)).alias("render_js"),
        F.coalesce("renderWaitMs", F.lit(0)).alias("render_wait_ms"),
    )


def clean_requests(requests: DataFrame) -> DataFrame:
    """Non-string -> '', trim with the JavaScript whitespace set, drop empties."""
    return (requests.select("run_id", "ord", js_trim(F.coalesce(F.col("raw_url"), F.lit(""))).alias("url"), *[
        c for c in requests.columns if c not in ("run_id", "ord", "raw_url")])
            .where(F.col("url") != ""))


def first_seen(cleaned: DataFrame) -> DataFrame:
    """Order-preserving dedupe per run on the trimmed raw string: keep the first ``ord``.

    A grouped ``min`` (partial aggregation before the shuffle; the key includes the URL, so a
    run holding a third of all rows still spreads over many tasks)."""
    others = [c for c in cleaned.columns if c not in ("run_id", "url", "ord")]
    return cleaned.groupBy("run_id", "url").agg(
        F.min("ord").alias("ord"), *[F.min_by(c, "ord").alias(c) for c in others])


def distinct_urls(requests: DataFrame) -> DataFrame:
    """The set of distinct URLs."""
    return requests.select("url").distinct()


def validate_runs(runs: DataFrame, unique: DataFrame) -> DataFrame:
    """A run with no usable URL fails as a whole (one run-level error row)."""
    counts = unique.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_urls"))
    r = runs.select("run_id").join(counts, "run_id", "left")
    n = F.coalesce(F.col("n_urls"), F.lit(0)).cast("bigint")
    return r.select("run_id", n.alias("n_urls"), F.when(n == 0, F.lit(MSG_NO_URLS)).alias("error"))


def request_options(unique: DataFrame, runs: DataFrame) -> DataFrame:
    """Attach run options to every request. ``runs`` has one row per run; Spark/AQE picks
    a broadcast only when the measured size is under the broadcast threshold."""
    r = runs.select("run_id", "event_limit", F.coalesce("include_links", F.lit(True)).alias("include_links"),
                    F.coalesce("render_js", F.lit(False)).alias("render_js"))
    return unique.join(r, "run_id").select(
        "*", F.when(F.col("render_js"), F.lit(EVENT_PAGE_RENDERED)).otherwise(F.lit(EVENT_PAGE_SCRAPED)).alias("event_name"))
