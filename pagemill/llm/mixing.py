"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Tokens are summed over cells of source, language and topic. Raking scales the cells' weights to each
target marginal in turn until all three hold. A document's sampling probability is its cell's weight
over the cell's tokens, scaled so that the largest is 1; a hash of the id draws the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

DIMS = ("source", "lang", "topic")
#: Target shares are the observed token shares to this power: below 1 lifts small groups.
POWER = 0.9
ROUNDS = 5
#: Cells up to this many rows are broadcast (under 10 MB); more are joined by shuffle.
BROADCAST_CELLS = 100_000


def words(text: str = "text") -> Column:
    """Tokens of a text, counted as its blanks and line ends plus one; null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (F.octet_length(t) - F.octet_length(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long")


def form(text: str = "text") -> Column:
    """The topic of a table without one: the form of its text."""
    t = F.col(text)
    return (
        F.when(t.isNull() | (t == ""), "empty")
        .when(t.contains(" | "), "table").when(t.contains("***") | t.contains("###"), "symbols")
        .when(t.contains("!! "), "shout").when(t.contains("icense"), "license")
        .when(F.octet_length(t) < 500, "short").when(F.octet_length(t) > 20000, "long").otherwise("prose")
    )


def with_cell(docs: DataFrame) -> DataFrame:
    """_row (all columns of ``docs``), _source, _lang, _topic (null: '(none)') and _tokens; a column
    ``topic`` is used if there is one, else the form of the text."""
    topic = F.col("topic").cast("string") if "topic" in docs.columns else form()
    none = F.lit("(none)")
    return docs.select(
        F.struct("*").alias("_row"), F.coalesce(F.col("source").cast("string"), none).alias("_source"),
        F.coalesce(F.col("lang").cast("string"), none).alias("_lang"), F.coalesce(topic, none).alias("_topic"), words().alias("_tokens"),
    )


def targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """The default target marginal: observed token shares, tempered."""
    return cells.groupBy(f"_{dim}").agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))


def rake(cells: DataFrame, goals: dict[str, DataFrame], rounds: int) -> DataFrame:
    """Scales ``weight`` to each goal (_dim, target; any scale) in turn. Values that a goal lacks get no weight."""
    for _ in range(rounds):
        for dim in DIMS:
            now = cells.groupBy(f"_{dim}").agg(F.sum("weight").alias("sum"))
            factor = now.join(goals[dim], f"_{dim}", "left").select(f"_{dim}", F.coalesce(F.col("target") / F.col("sum"), F.lit(0.0)).alias("factor"))
            cells = checkpointed(cells.join(factor, f"_{dim}").withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"))
    return cells


def probabilities(docs: DataFrame, goals: dict[str, DataFrame] | None = None, power: float = POWER, rounds: int = ROUNDS) -> DataFrame:
    """_source, _lang, _topic, probability of every cell of ``docs``."""
    cells = checkpointed(with_cell(docs).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")).withColumn("weight", F.col("tokens").cast("double")))
    goals = {dim: checkpointed(goals[dim] if goals and dim in goals else targets(cells, dim, power)) for dim in DIMS}
    raked = rake(cells, goals, rounds)
    top = raked.agg(F.max(F.col("weight") / F.col("tokens"))).first()[0]
    return raked.select("_source", "_lang", "_topic", F.round(F.col("weight") / F.col("tokens") / F.lit(top or 1.0), 9).alias("probability"))


def draw(docs: DataFrame, **how) -> DataFrame:
    """The cells of with_cell(docs) with ``probability`` and the ``kept`` that the hash of doc_id draws.

    Rows that repeat a doc_id share a draw; null doc_ids draw as the empty text; null sources,
    languages and topics are groups of their own; empty texts weigh one token; an empty table gives
    no rows; further columns are carried whatever their names.
    """
    cells = probabilities(docs, **how)
    small = cells.count() <= BROADCAST_CELLS
    key = F.concat(F.lit("mix:"), F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")))
    uniform = F.conv(F.substr(F.md5(key.cast("binary")), F.lit(1), F.lit(12)), 16, 10).cast("double") / F.lit(float(16**12))
    return with_cell(docs).join(F.broadcast(cells) if small else cells, ["_source", "_lang", "_topic"]).withColumn("kept", uniform < F.col("probability"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, probability, kept."""
    return draw(docs, **how).select("_row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), "probability", "kept")


def sample(docs: DataFrame, **how) -> DataFrame:
    """The drawn documents, with the columns of ``docs``."""
    return draw(docs, **how).where("kept").select("_row.*")
