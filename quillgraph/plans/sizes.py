"""Broadcasts that are allowed only after a look at the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows (counted without reading further), else unchanged,
    so that the join falls back to a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """`df` whose joins shuffle it. Spark takes the size of files for that of their rows, before and after these are exploded, and may
    broadcast far more than its limit."""
    return df.hint("merge")
