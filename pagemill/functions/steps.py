"""Columns computed once, whatever uses them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(df: DataFrame, **columns: str | Column) -> DataFrame:
    """``df`` with further columns (SQL text or columns), each computed once for every row.

    Merged projections would put a column's expression into each of its uses, array functions among
    them, where it is computed for every element, and plans would grow with every use; a generator
    between the projections keeps them apart."""
    keep = [c for c in df.columns if c not in columns]
    made = [(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return df.select(*keep, F.inline_outer(F.array(F.struct(*made))))
