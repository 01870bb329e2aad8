"""Bounded samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: str, *cols: str) -> Column:
    """A number from 0 to 1 that the columns' values decide."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)).cast("double") / float(1 << 30)


def per_class(rows: DataFrame, label: str, key: str, most: int, seed: str, classes: int = 1000) -> DataFrame:
    """About ``most`` rows of each value of ``label`` (all, if there are fewer), drawn by the hash of
    ``key``; of the ``classes`` most frequent values, so the sample is bounded by most * classes."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), label).limit(classes)
    return rows.join(F.broadcast(counts), label).where(uniform(seed, key) * F.col("_n") < most).drop("_n")
