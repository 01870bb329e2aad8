"""Structured Streaming front ends.

Per-page token windows are non-time windows, which streaming aggregation does not allow, so
the page path runs per micro-batch inside ``foreachBatch`` (J1). Delivery is keyed by batch
id and overwritten on replay, and metering is derived from what was delivered (J5)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.options import DEFAULT, Options
from pagemill.plans.clean import clean_pages

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def read_pages_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Pages as their files land; ``max_files`` bounds a micro-batch, which else takes all that has landed."""
    reader = spark.readStream.schema(PAGES_SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def deliver_batch(out_dir: str, opts: Options = DEFAULT):
    """Clean one micro-batch and (over)write it under its batch id: a replayed batch
    rewrites the same folder, so nothing is delivered or metered twice."""
    def run(batch: DataFrame, batch_id: int) -> None:
        clean_pages(batch, opts).withColumn("batch_id", F.lit(batch_id)) \
            .write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
    return run


def clean_pages_stream(spark: SparkSession, src: str, out_dir: str, checkpoint: str, opts: Options = DEFAULT):
    """Clean pages as they land; returns the started query (availableNow trigger)."""
    return (read_pages_stream(spark, src).writeStream.foreachBatch(deliver_batch(out_dir, opts))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def dedupe_urls_stream(events: DataFrame, ts: str = "ts", key: str = "url", delay: str = "1 hour") -> DataFrame:
    """Drop repeated URLs within the watermark (event time must be TIMESTAMP, not NTZ)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def meter_hourly_stream(events: DataFrame, ts: str = "ts", name: str = "event_type", delay: str = "1 hour") -> DataFrame:
    """Events per tumbling hour and name; late rows beyond the watermark are dropped."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return e.groupBy(F.window(ts, "1 hour").alias("w"), name).agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("w.start").alias("hour"), name, "n")


class RunBudget(StatefulProcessor):
    """Each run's budget over rows that come in any order, in any number of batches.

    Rows wait in a map by ``seq`` (their place in the run's input, 0, 1, ...) until all earlier ones have come; then they
    leave in that order until the success that reaches the limit. The value holds the next place and the
    successes so far. A row that comes again is ignored; after the limit rows are dropped as they come, so
    the state of a finished run is two numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "seq bigint", "ord bigint, error string")
        self.progress = handle.getValueState("progress", "next bigint, done bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        place, done = self.progress.get() if self.progress.exists() else (0, 0)
        out, limit = [], None
        for frame in rows:
            for seq, ord_, error, event_limit in zip(frame["seq"].tolist(), frame["ord"].tolist(), frame["error"].tolist(), frame["event_limit"].tolist()):
                limit = None if pd.isna(event_limit) else max(int(event_limit), 1)
                if seq < place or (limit is not None and done >= limit):
                    continue
                self.waiting.updateValue((seq,), (ord_, None if pd.isna(error) else error))
        while (limit is None or done < limit) and self.waiting.containsKey((place,)):
            ord_, error = self.waiting.getValue((place,))
            self.waiting.removeKey((place,))
            out.append((key[0], ord_, error))
            place, done = place + 1, done + (error is None)
        if limit is not None and done >= limit:
            self.waiting.clear()
        self.progress.update((place, done))
        yield pd.DataFrame(out, columns=["run_id", "ord", "error"])

    def close(self) -> None:
        pass


def budget_stream(outcomes: DataFrame) -> DataFrame:
    """Outcomes (run_id, seq, ord, error, event_limit) -> the delivered (run_id, ord, error), the same rows as the batch cut-off."""
    return outcomes.groupBy("run_id").transformWithStateInPandas(RunBudget(), "run_id bigint, ord bigint, error string", "append", "none")
