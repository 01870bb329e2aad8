"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node that has a link and isn't a root.

    ``links`` has the long columns a and b. Each round links every node's larger neighbours to its
    smallest one, then its smaller ones; minima are aggregated before the shuffle and joined back, so
    a node with very many links is dealt over tasks. Rounds end when nothing moves.
    """
    edges = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
