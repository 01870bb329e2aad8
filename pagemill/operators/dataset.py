"""Dataset, budget and metering operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.options import MSG_UNEXPECTED_PREFIX, STATUS_BUDGET_SUFFIX, STATUS_DONE

DATASET_COLUMNS = ["run_id", "ord", "url", "title", "excerpt", "site_name", "word_count", "markdown", "error"]
BUDGET_BUCKET = 1 << 16  # ords per bucket in the two-level prefix sum


def first_error(*rules) -> F.Column:
    """The first failing rule wins; ``rules`` are (condition, message) pairs in order."""
    e = None
    for cond, msg in rules:
        e = F.when(cond, msg) if e is None else e.when(cond, msg)
    return e


def friendly(error_col, scrape_error: F.Column) -> F.Column:
    """Known errors verbatim; anything else gets the ``Unexpected error: `` prefix."""
    return F.when(scrape_error, error_col).otherwise(F.concat(F.lit(MSG_UNEXPECTED_PREFIX), error_col))


def dataset_union(ok: DataFrame, errors: DataFrame) -> DataFrame:
    """success and error records in one dataset (missing columns are NULL)."""
    u = ok.unionByName(errors, allowMissingColumns=True)
    return u.select(*[c for c in DATASET_COLUMNS if c in u.columns])


def budget_cuts(outcomes: DataFrame, runs: DataFrame, bucket: int = BUDGET_BUCKET) -> DataFrame:
    """(run_id, cut_ord) of the runs that reach their limit: the ord of the success that does.

    Only the ords of successes of limited runs move. They are counted by (run, ord bucket), running totals
    of the buckets show the one in which the limit falls, and that bucket's ords are sorted: no task sees
    more than a bucket's ords, or a run's buckets."""
    limited = runs.where(F.col("event_limit").isNotNull()).select("run_id", F.greatest("event_limit", F.lit(1)).alias("_limit"))
    ok = outcomes.where(F.col("error").isNull()).select("run_id", "ord", F.floor(F.col("ord") / bucket).alias("_bucket"))
    ok = ok.join(limited, "run_id").repartition("run_id", "_bucket")  # one exchange for both uses
    earlier = Window.partitionBy("run_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = ok.groupBy("run_id", "_bucket", "_limit").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_need", F.col("_limit") - F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    last = counts.where(F.col("_need").between(1, F.col("_n"))).select("run_id", "_bucket", "_need")
    place = F.row_number().over(Window.partitionBy("run_id", "_bucket").orderBy("ord"))
    return ok.join(last, ["run_id", "_bucket"]).select("run_id", "ord", "_need", place.alias("_place")) \
        .where(F.col("_place") == F.col("_need")).select("run_id", F.col("ord").alias("cut_ord"))


def budget_cutoff(outcomes: DataFrame, runs: DataFrame, bucket: int = BUDGET_BUCKET) -> DataFrame:
    """In ``ord`` order per run, keep rows until (and including) the success that reaches
    the limit; failures are free; limit 0 still delivers one page; NULL = unlimited.

    Rows meet their run's cut ord (one narrow row for each limited run) and move no further."""
    cuts = budget_cuts(outcomes, runs, bucket)
    return outcomes.join(cuts, "run_id", "left").where(F.col("cut_ord").isNull() | (F.col("ord") <= F.col("cut_ord"))).drop("cut_ord")


def unprocessed(requests: DataFrame, delivered: DataFrame) -> DataFrame:
    """Requests never attempted because the run stopped at its budget."""
    return requests.join(delivered.select("run_id", "ord"), ["run_id", "ord"], "left_anti")


def run_summary(delivered: DataFrame, runs: DataFrame) -> DataFrame:
    """D3: succeeded, failed and budget_reached per run (runs without rows included)."""
    g = delivered.groupBy("run_id").agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("succeeded"),
        F.count(F.when(F.col("error").isNotNull(), 1)).alias("failed"),
    )
    r = runs.select("run_id", "event_limit").join(g, "run_id", "left")
    s = F.coalesce(F.col("succeeded"), F.lit(0)).cast("bigint")
    return r.select(
        "run_id", s.alias("succeeded"), F.coalesce(F.col("failed"), F.lit(0)).cast("bigint").alias("failed"),
        (F.col("event_limit").isNotNull() & (s >= F.greatest(F.col("event_limit"), F.lit(1)))).alias("budget_reached"),
    )


def run_status(summary: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """``Done. Scraped S page(s), F failed`` + `` (stopped at charge limit).`` or ``.``;
    runs that failed validation report their error instead."""
    msg = F.concat(
        F.format_string(STATUS_DONE.replace("{}", "%d"), F.col("succeeded"), F.col("failed")),
        F.when(F.col("budget_reached"), F.lit(STATUS_BUDGET_SUFFIX)).otherwise(F.lit(".")),
    )
    out = summary.select("run_id", msg.alias("status"))
    if validation is not None:
        out = out.join(validation.select("run_id", "error"), "run_id", "left").select(
            "run_id", F.coalesce(F.col("error"), F.col("status")).alias("status"))
    return out


def meter_events(delivered: DataFrame, requests_with_options: DataFrame) -> DataFrame:
    """One event per delivered success, named by the run's mode; failures never metered.
    Derived from the delivered dataset, so a replayed batch cannot double-charge (J5)."""
    ok = delivered.where(F.col("error").isNull()).select("run_id", "ord")
    named = ok.join(requests_with_options.select("run_id", "ord", "event_name"), ["run_id", "ord"])
    return named.groupBy("run_id", "event_name").agg(F.count(F.lit(1)).alias("n"))


def render_document(results: DataFrame) -> DataFrame:
    """A5: the single-page text document: header lines (falsy ones omitted), rule, Markdown."""
    header = F.concat_ws(
        "\n",
        F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.lit("# "), F.col("title"))),
        F.when(F.coalesce(F.col("site_name"), F.lit("")) != "", F.concat(F.lit("**Source:** "), F.col("site_name"))),
        F.concat(F.lit("**URL:** "), F.col("url")),
        F.concat(F.lit("**Words:** "), F.col("word_count").cast("string")),
    )
    return results.select("*", F.concat(header, F.lit("\n\n---\n\n"), F.col("markdown")).alias("document"))


def iso_utc(ts) -> F.Column:
    """ISO-8601 UTC with milliseconds, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def write_dataset(df: DataFrame, path: str, batch_id: int, scraped_at, fmt: str = "parquet") -> None:
    """A4/F1: the dataset's rows of one batch, with the time they were scraped, in input order within each run.

    Rows lie in folders by run and batch, and writing a batch again replaces its folders and no others, so a
    replay changes nothing. Files of a folder follow ``ord``: ranges of (run, ord), sorted."""
    out = df.withColumn("batch_id", F.lit(batch_id)).withColumn("scraped_at", iso_utc(F.lit(scraped_at).cast("timestamp")))
    out.repartitionByRange("run_id", "ord").sortWithinPartitions("run_id", "ord").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch_id").format(fmt).save(path)


def read_dataset(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """the dataset in input order."""
    return spark.read.format(fmt).load(path).orderBy("run_id", "ord")
