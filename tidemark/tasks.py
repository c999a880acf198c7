"""Rows dealt out over tasks before Python works on them: a small file, or a join that adaptive execution has coalesced, would be one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 20_000  # rows of a task, about


def spread(df: DataFrame, key: str, rows: int, each: int | None = None) -> DataFrame:
    """df, dealt by its key over as many tasks as `rows`, its number of rows, asks for. Columns that are made of others are best made after this."""
    return df.repartition(max(1, -(-rows // (each or ROWS))), key)
